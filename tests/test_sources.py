import datetime
import json

import pytest

from tallyforge.plans import catalog
from tallyforge.plans import every as _registered  # noqa: F401
from tallyforge.sources import documents, packs, runs, statements


def test_layouts_by_header():
    name = lambda *h: statements.named_layout(h)[0].name
    assert name("Transaction ID", "Date", "Emoji", "Category", "Name", "Amount", "Description") == "app with emoji"
    assert name("﻿Date", " COUNTER party ", "Amount (GBP)") == "app with counter party"
    assert name("Date", "Description", "Paid Out", "Paid In") == "paid out and in"
    assert name("Date", "Payee", "Inflow") == "inflow" and name("Date", "Payee", "Outflow") == "outflow"
    assert name("Date", "Description", "Amount") == "signed" and name("Date", "Description", "Debit", "Credit") == "split"
    assert statements.named_layout(["When", "What"]) is None


def test_statement_and_rejects(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Date,Description,Amount\n2024-01-05,Shop,-9.50\n2024-01-06,"Pay, monthly",2000\n2024-02-30,Bad,1\n2024-01-07, ,1\n2024-01-08,X,\n2024-01-09,X,"1,000"\n2024-01-10,X,0.00\n2024-01-11,X,1e3\n')
    good, bad = statements.read_input(spark, str(path))
    assert [(r.raw_merchant, str(r.amount), r.direction) for r in good.orderBy("seq").collect()] == [("Shop", "9.50", "debit"), ("Pay, monthly", "2000.00", "credit")]
    assert [r.reason for r in bad.orderBy("seq").collect()] == ["bad_date", "no_merchant", "no_amount", "bad_amount", "zero_amount", "bad_amount"]


def test_only_an_amount_of_nothing_is_zero(spark, tmp_path):
    (tmp_path / "signed.csv").write_text("Date,Description,Amount\n2024-01-05,A,-0.004\n2024-01-06,B,0.0000007\n2024-01-07,C,0.000\n2024-01-08,D,-0\n")
    good, bad = statements.read_statement(spark, str(tmp_path / "signed.csv"))
    assert [(r.raw_merchant, str(r.amount), r.direction) for r in good.orderBy("seq").collect()] == [("A", "0.00", "debit"), ("B", "0.00", "credit")]
    assert [(r.raw_merchant, r.reason) for r in bad.orderBy("seq").collect()] == [("C", "zero_amount"), ("D", "zero_amount")]


def test_rejects_of_events_worth_less_than_a_penny(spark, tmp_path):
    values = (0.0, 0.004, 5e-324, 0.005, 29.27)
    rows = [(8 * i + k, datetime.datetime(2024, 1, 5), "click", v) for i, v in enumerate(values) for k in (5, 6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = [(r.reason, str(r.amount), r.direction) for r in catalog.queries()["rejects"](spark, str(tmp_path)).orderBy("event_id").collect()]
    assert found[:2] == [("zero_amount", "None", None)] * 2
    assert found[2:] == [(None, a, d) for a in ("0.00", "0.00", "0.01", "29.27") for d in ("credit", "debit")]


def test_split_columns_and_card(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Paid Out,Paid In\n05 Jan 24,Shop,-3.00,\n06/01/2024,Pay,,10\n07 Jan 2024,Both,1,2\n08 Jan 24,None,,\n")
    good, bad = statements.read_statement(spark, str(tmp_path / "a.csv"))
    assert [(str(r.date), str(r.amount), r.direction) for r in good.orderBy("seq").collect()] == [("2024-01-05", "3.00", "debit"), ("2024-01-06", "10.00", "credit")]
    assert [r.reason for r in bad.orderBy("seq").collect()] == ["two_amounts", "no_amount"]
    (tmp_path / "b.csv").write_text("Date,Payee,Outflow\n18-Dec-25,Shop,5\n18-Dec-2025,Refund,-2\n")
    good, _ = statements.read_statement(spark, str(tmp_path / "b.csv"))
    assert [(str(r.date), r.direction) for r in good.orderBy("seq").collect()] == [("2025-12-18", "debit"), ("2025-12-18", "credit")]


def test_positions(spark, tmp_path):
    row = ["id", "2019-03-04 10:11:12 +0000", "-4.20", "GBP", "-4.20", "GBP", "eating", "x", "CAFE 12", "", "", ""]
    (tmp_path / "old.csv").write_text(",".join(f"h{i}" for i in range(12)) + "\n" + ",".join(row) + "\n")
    good, _ = statements.read_statement(spark, str(tmp_path / "old.csv"))
    assert [(str(r.date), r.raw_merchant, str(r.amount), r.direction) for r in good.collect()] == [("2019-03-04", "CAFE 12", "4.20", "debit")]
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(statements.UnknownLayout):
        statements.read_statement(spark, str(tmp_path / "none.csv"))
    with pytest.raises(statements.UnknownLayout):
        statements.read_input(spark, "x.pdf")


def test_positions_after_a_long_preamble(spark, tmp_path):
    old = ["id", "2019-03-04 10:11:12 +0000", "-4.20", "GBP", "-4.20", "GBP", "eating", "x", "CAFE 12", "", "", ""]
    card = ["", "", "05/01/2024", "SHOP", "3.10", "GBP", "3.10", "GBP", "1.00", "06/01/2024", *[""] * 10]
    for row, name in ((old, "CAFE 12"), (card, "SHOP")):
        lines = [[f"h{i}" for i in range(len(row))], *[["foreign"] * len(row)] * 120, row]
        (tmp_path / "late.csv").write_text("\n".join(map(",".join, lines)) + "\n")
        good, bad = statements.read_statement(spark, str(tmp_path / "late.csv"))
        assert [r.raw_merchant for r in good.collect()] == [name]
        assert bad.count() == 120


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.MD").write_text("three")
    got = documents.read_documents(spark, [str(tmp_path / "b.MD"), str(tmp_path / "a.txt")]).orderBy("document").collect()
    assert [(r.document, r.text) for r in got] == [(0, "three"), (1, "one\ntwo")]
    with pytest.raises(ValueError):
        documents.read_documents(spark, ["x.pdf"])


def pack_at(folder, **changes):
    raw = {"id": "a.b", "version": "1", "inputs": [{"name": "statement", "least": 1, "most": 2}], "steps": [{"kind": "preprocess", "name": "merchant-cleanup"}, {"kind": "aggregate", "name": "recurrence-detect"}]} | changes
    (folder / "pack.json").write_text(json.dumps(raw))
    return packs.load(folder)


def test_packs(tmp_path):
    pack = pack_at(tmp_path)
    assert packs.bind_sole(pack, ["x.csv", "y.csv"]) == [("statement", "x.csv"), ("statement", "y.csv")]
    for given in ({}, {"statement": ["a.csv"] * 3}, {"other": ["a.csv"]}, {"statement": ["a.pdf"]}):
        with pytest.raises(packs.PackError):
            packs.bind(pack, given)
    bad = [
        {"steps": [{"kind": "wasm"}]},
        {"steps": [{"kind": "aggregate", "name": "sum"}]},
        {"steps": [{"kind": "model", "name": "classify", "files": {"prompt": "../x"}}]},
        {"steps": [{"kind": "model", "name": "classify", "schema": {"oneOf": []}}]},
        {"steps": [{"kind": "aggregate", "name": "term-diff"}]},
        {"extra": 1},
        {"inputs": []},
    ]
    for change in bad:
        with pytest.raises(packs.PackError):
            pack_at(tmp_path, **change)
    assert packs.authored_id("a-b-c1") and not packs.authored_id("a-b") and not packs.is_contained("/etc")


def test_runs(spark, tmp_path):
    from decimal import Decimal

    frame = spark.createDataFrame([(1, Decimal("1.50"))], "a int, m decimal(10,2)")
    runs.write_once(frame, str(tmp_path / "out"))
    assert '"m":"1.50"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))  # rows lie in any of the parts
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runs.write_once(frame, str(tmp_path / "out"))
    assert runs.content_key([b"ab", b"c"]) != runs.content_key([b"a", b"bc"])
    assert runs.cache_key("p", "1", "m", ["x", "y"]) == runs.cache_key("p", "1", "m", ["y", "x"])
    assert runs.within(tmp_path, tmp_path / "out") and runs.within(tmp_path, tmp_path / "../z") is None


def put(root, **files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_recorded_runs_by_policy_and_prompt(spark, tmp_path):
    from tallyforge.operators import answers

    put(tmp_path, **{
        "a/run.json": '{"request": {"t": "0", "seed": 1}, "model": {"file": "m"}}',
        "a/x/raw/0001-say.request.txt": "who?", "a/x/raw/0001-say.response.json": "one",
        "a/y/run.json": '{"request": {"seed": 2, "t": 0}}',
        "a/y/raw/0001-say.request.json": "who?", "a/y/raw/0001-say.response.json": "two",
        "a/y/raw/0002-say.request.txt": "cut off",
        "a/z/run.json": '{"model": {"file": "m"}}', "a/z/raw/0003-say.request.txt": "when?", "a/z/raw/0003-say.response.json": "three",
        "b/raw/0001-say.request.txt": "who?", "b/raw/0001-say.response.json": "four",
        "b/raw/notes.txt": "?",
    })
    recorded = runs.recording(spark, str(tmp_path), current='{"seed": 9}')
    ask = lambda *rows: sorted(r.answer for r in answers.replayed(spark.createDataFrame(rows, "policy string, prompt string"), recorded).collect())
    assert ask(('{"seed": 1, "t": "0"}', "who?"), ('{"t":"0","seed":"2"}', "who?"), ('{"seed":1,"t":0}', "when?"), ('{"seed": 9}', "who?")) == ["four", "one", "three", "two"]
    for policy, prompt in (('{"seed": 2, "t": "0"}', "when?"), ("{}", "who?"), ('{"seed": 2, "t": "0"}', "cut off")):
        with pytest.raises(Exception, match="no answer"):
            ask((policy, prompt))
    put(tmp_path, **{"c/run.json": '{"request": {"seed": 9}}', "c/1.request.txt": "who?", "c/1.response.json": "five"})
    with pytest.raises(Exception, match="two answers"):
        answers.replayed(spark.createDataFrame([('{"seed": 9}', "who?")], "policy string, prompt string"), runs.recording(spark, str(tmp_path), '{"seed": 9}')).collect()
    put(tmp_path, **{"c/run.json": '{"model": {"file": "other"}}'})
    with pytest.raises(ValueError, match="more than one model"):
        runs.recording(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    put(tmp_path, **{"none/1.request.txt": "who?"})
    with pytest.raises(ValueError, match="no recorded answers"):
        runs.recording(spark, str(tmp_path / "none"))


def test_a_run_is_taken_up_where_it_stopped(spark, tmp_path):
    from pyspark.sql import functions as F

    items, done = spark.range(100).select("id"), []

    def work(rows):
        done.extend(r.id for r in rows.collect())
        if len(done) > 40 and not stopped:
            stopped.append(True)
            raise RuntimeError("the machine went away")
        return rows.withColumn("score", F.col("id") * 2)

    stopped: list[bool] = []
    log = lambda *identity: runs.FinishedLog(spark, str(tmp_path), identity, "id long, score long")
    with pytest.raises(RuntimeError):
        log("pack", "1").run(items, ["id"], work, 8)
    kept = {r.id for r in log("pack", "1").finished().collect()}
    (next(tmp_path.iterdir()) / "_unfinished-half").mkdir()  # of a write that never ended
    began = len(done)
    got = {r.id: r.score for r in log("pack", "1").run(items, ["id"], work, 8).collect()}
    assert got == {i: 2 * i for i in range(100)}
    assert 0 < len(kept) < 100 and not kept & set(done[began:]) and len(done) - began == 100 - len(kept)
    assert log("pack", "2").finished().count() == 0  # another identity has nothing finished
    log("pack", "1").run(items, ["id"], work, 8)
    assert len(done) - began == 100 - len(kept)


def test_pages_are_written_wholly_or_not_at_all(spark, tmp_path):
    from tallyforge.operators import reports
    from tallyforge.sources import files

    rows = spark.createDataFrame([(k, i, f"<{i} & 'x'>") for k in range(12) for i in (2, 1)], "k int, i int, t string")
    made = reports.pages(rows, "k", ["i"], ["i", "t"], "Of")
    reports.write_pages(made.repartition(5), "k", str(tmp_path / "out"))
    got = {r.name: r.content for r in files.read_files(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 12 and "<td>1</td><td>&lt;1 &amp; &#x27;x&#x27;&gt;</td></tr><tr><td>2</td>" in got["3.html"]
    bad = made.unionByName(spark.createDataFrame([(99, "<img src=http://x/y.png>")], "k int, html string"))
    for wrong, why in ((bad, "loads"), (spark.createDataFrame([("../up", "x")], "k string, html string"), "no name"), (spark.createDataFrame([("a", "x"), ("a", "y")], "k string, html string").coalesce(1), "exists")):
        with pytest.raises(Exception, match=why):
            reports.write_pages(wrong, "k", str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").rglob("*.html"))
    assert not list(tmp_path.rglob("_staging*"))


def test_a_folder_is_one_scan_with_rows_numbered_by_file(spark, tmp_path):
    for name, days in (("b", (1, 2, 3)), ("a b", (4, 31, 5))):
        lines = ["Date,Description,Amount", *(f"2024-{'02' if d == 31 else '01'}-{d},shop {d},-{d}.00" for d in days)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    paths = [str(tmp_path / "b.csv"), str(tmp_path / "a b.csv")]
    good, bad = statements.read_folder(spark, paths)
    assert [(r.part, r.row_no, str(r.amount)) for r in good.orderBy("part", "row_no").collect()] == [(0, 2, "1.00"), (0, 3, "2.00"), (0, 4, "3.00"), (1, 2, "4.00"), (1, 4, "5.00")]
    assert [(r.part, r.row_no, r.reason) for r in bad.collect()] == [(1, 3, "bad_date")]


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    files = {
        "one": ["Date,Description,Amount", '2024-01-05,"Shop, the ""old"" one",-5.00'],
        "two": ["date,AMOUNT,description", "2024-01-06,-5.00,Shop", "2024-01-07,x,Shop"],
        "three": ["Paid In,Paid Out,Description,Date", ",7.00,Rent,05 Jan 24", "9,,Pay,06/01/2024"],
        "four": [",".join(f"h{i}" for i in range(12)), ",".join(["id", "2019-03-04 10:11:12 +0000", "-4.20", "GBP", "-4.20", "GBP", "", "x", "CAFE", "", "", ""])],
        "odd": ["a,b", "1,2", "3,4"],
        "empty": [],
    }
    for name, lines in files.items():
        (tmp_path / f"{name}.csv").write_text("".join(x + "\n" for x in lines))
    paths = [str(tmp_path / f"{n}.csv") for n in files]
    with pytest.raises(statements.UnknownLayout, match="odd"):
        statements.read_files(spark, paths)
    good, bad = statements.read_files(spark, paths, strict=False)
    name = lambda r: r.src_file.rsplit("/", 1)[-1].removesuffix(".csv")
    assert sorted((name(r), r.layout, r.row_no, str(r.date), r.raw_merchant, str(r.amount), r.direction) for r in good.collect()) == [
        ("four", "twelve columns", 2, "2019-03-04", "CAFE", "4.20", "debit"),
        ("one", "signed", 2, "2024-01-05", 'Shop, the "old" one', "5.00", "debit"),
        ("three", "paid out and in", 2, "2024-01-05", "Rent", "7.00", "debit"),
        ("three", "paid out and in", 3, "2024-01-06", "Pay", "9.00", "credit"),
        ("two", "signed", 2, "2024-01-06", "Shop", "5.00", "debit"),
    ]
    assert sorted((name(r), r.row_no, r.reason) for r in bad.collect()) == [("odd", 1, "unknown_layout"), ("two", 3, "bad_amount")]


def test_rows_of_a_file_in_many_blocks_are_numbered_through(spark, tmp_path):
    lines = ["Date,Description,Amount", *(f"2024-01-05,shop,-{i}.00" for i in range(1, 3000))]
    (tmp_path / "long.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "short.csv").write_text("Description,Amount,Date\nshop,-1.00,2024-01-05\n")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        good, bad = statements.read_files(spark, [str(tmp_path / "long.csv"), str(tmp_path / "short.csv")])
        assert good.rdd.getNumPartitions() > 0 and bad.count() == 0
        rows = good.where("src_file LIKE '%long.csv'").collect()
        assert statements.scanned(spark, [str(tmp_path / "long.csv")])[1].count() > 5
        assert len(rows) == 2999 and all(r.row_no == int(r.amount) + 1 for r in rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_dates_of_one_digit_and_two_digit_years(spark):
    from pyspark.sql import functions as F

    from tallyforge.functions import dates as D

    rows = [("5/1/2024", "2024-01-05"), ("05/01/2024", "2024-01-05"), ("05 Jan 98", "1998-01-05"), ("5 january 69", "2069-01-05"), ("1 Feb 70", "1970-02-01"), ("29 Feb 96", "1996-02-29"), ("2024-1-5", "2024-01-05"), ("31/02/2024", None), ("", None)]
    got = spark.createDataFrame(rows, "text string, want string").select("text", "want", D.parse_date(F.col("text"), ("dd MMM yy", "dd/MM/yyyy", "yyyy-MM-dd")).cast("string").alias("read")).collect()
    assert [(r.text, r.read) for r in got] == [(r.text, r.want) for r in got]


def test_questions_are_the_same_in_any_partitioning(spark):
    from tallyforge.sources import asking

    def echo(prompt, schema):
        items = [__import__("json").loads(x) for x in prompt.split("\n")]
        return __import__("json").dumps({"results": [{"id": i["id"], "text": i["text"], "with": len(items)} for i in items]})

    schema = {"type": "object", "properties": {"results": {"type": "array", "items": {"type": "object"}}}, "required": ["results"]}
    items = spark.range(100).selectExpr("id", "concat('text ', id) AS text")
    one = sorted(map(tuple, asking.asked(items.coalesce(1), echo, "{items}", schema, 6).collect()))
    assert one == sorted(map(tuple, asking.asked(items.repartition(7), echo, "{items}", schema, 6).collect()))
    assert all(r[2] and r[3] is None for r in one)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    from tallyforge.sources import files

    root = tmp_path / "out"
    rows = spark.range(300).selectExpr("concat('f', id, '/', id, '.txt') AS name", "if(id = 7, '', concat('text ', id)) AS content")
    files.write_files(rows.repartition(3), str(root))
    (root / "_staging-of-another").mkdir()
    (root / "_staging-of-another" / "x.txt").write_text("not finished")
    found = files.read_files(spark, str(root))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = found.collect()
    assert {r.name: r.content for r in got} == {f"f{i}/{i}.txt": f"text {i}" for i in range(300) if i != 7}
    assert all(r.path.startswith(f"file://{root}/part-") for r in got)


def test_headers_are_found_without_sorting_rows_and_files_scanned_once_for_all(spark, tmp_path):
    cells = ",".join(["Account", "2024-01-05 10:00:00 +0000", "-9.50", "GBP", "9.50", "GBP", "a", "b", "Shop", "c", "d", "e"])
    (tmp_path / "old.csv").write_text("x1,x2,x3,x4,x5,x6,x7,x8,x9,x10,x11,x12\n" + cells + "\n")
    (tmp_path / "signed.csv").write_text("Amount,Date,Description\n-1.00,2024-01-05,Date Description Amount\nAmount,Date,Description\n")
    paths = [str(tmp_path / n) for n in ("old.csv", "signed.csv")]
    plan = statements.scanned(spark, paths)[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    read = statements.read_all(spark, paths)
    assert read._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2  # headers, rows
    assert sorted((r.layout, r.row_no, r.raw_merchant, r.reason) for r in read.collect()) == [("signed", 2, "Date Description Amount", None), ("signed", 3, "Description", "bad_date"), ("twelve columns", 2, "Shop", None)]
