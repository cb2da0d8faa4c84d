import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % media.UNIT == 0 and payload and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
    stream = media.encode(payload)
    got = media.parse(stream)
    assert got.payload == payload
    assert got.bad_checksums == 0 and got.skipped == 0
    assert got.table["frames"] == len(got.offsets)
    assert got.table["bytes"] == len(stream) - len(media.TAG)
    assert got.seconds == len(got.offsets) * 1152 / 48000
    assert got.tags == {"TIT2": "text payload"}


@pytest.mark.parametrize("size", [0, 575, 576, 936, 937, 938, 2 * 937, 9 * 937 + 1])
def test_sizes_at_frame_edges(size):
    payload = media.padded(b"\xff\xfa" * (size // 2) + b"x" * (size % 2))
    assert media.parse(media.encode(payload)).payload == payload


def test_resynchronises_after_damage():
    stream = media.encode(media.padded(b"hello " * 1000))
    whole = media.parse(stream)
    second = int(whole.offsets[1])
    hurt = media.parse(stream[:second] + b"\xff\xfajunk" + stream[second:])
    assert len(hurt.offsets) == len(whole.offsets) and hurt.skipped == 6
    flipped = bytearray(stream)
    flipped[second + 7] ^= 1  # in the side information, which the checksum covers
    assert media.parse(bytes(flipped)).bad_checksums == 1
    assert media.parse(b"").payload == b"" and len(media.parse(b"no frames at all").offsets) == 0
    assert media.parse(stream[:-5]).skipped > 0


def test_table_is_held_against_the_frames(spark):
    stream = media.encode(media.padded(b"hello " * 5000))
    at = stream.index(b"Xing")
    whole = media.parse(stream)
    assert whole.seek == stream[at + 16 : at + 116] and whole.table["quality"] == 0
    wrong = [stream]
    for place in (at + 11, at + 15, at + 16, at + 66, at + 115):  # frames, bytes, three seek entries
        hurt = bytearray(stream)
        hurt[place] ^= 1
        wrong.append(bytes(hurt))
    rows = spark.createDataFrame(list(enumerate(map(bytearray, wrong))), "doc_id long, media binary")
    got = {r.doc_id: r for r in media.read(rows).collect()}
    assert [got[i].table_agrees for i in range(6)] == [True] + [False] * 5
    assert len({r.payload_sha256 for r in got.values()}) == 1


def made(version, mode, bitrate=5, rate=0, protected=True, fill=0x41):
    """A silent frame by the format's rules: version bits, channel mode, and its free bytes."""
    low = version != 3
    kbits = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80)[bitrate] if low else (0, 32, 40, 48, 56, 64, 80, 96)[bitrate]
    hertz = (44100, 48000, 32000)[rate] // {3: 1, 2: 2, 0: 4}[version]
    side = {(False, False): 32, (False, True): 17, (True, False): 17, (True, True): 9}[low, mode == 3]
    size = (72000 if low else 144000) * kbits // hertz
    head = bytes((0xFF, 0xE0 | version << 3 | 2 | (not protected), bitrate << 4 | rate << 2, mode << 6))
    crc = media.crc16(head[2:] + bytes(side)).to_bytes(2, "big") if protected else b""
    lead = head + crc + bytes(side)
    return lead + bytes([fill]) * (size - len(lead)), side, (576 if low else 1152) / hertz


@pytest.mark.parametrize("protected", [True, False])
@pytest.mark.parametrize("mode", [0, 1, 2, 3])
@pytest.mark.parametrize("version", [3, 2, 0])
def test_frames_of_every_version_and_channel_mode(version, mode, protected):
    frame, side, seconds = made(version, mode, protected=protected)
    got = media.parse(frame * 5)
    assert got.offsets.tolist() == [len(frame) * k for k in range(5)]
    assert got.bad_checksums == 0 and got.skipped == 0
    assert got.seconds == pytest.approx(5 * seconds)
    assert got.payload == b"A" * len(got.payload) and len(got.payload) == 5 * (len(frame) - 4 - 2 * protected - side)
    hurt = bytearray(frame * 5)
    hurt[len(frame) + 8] ^= 4  # in the second frame's side information
    assert media.parse(bytes(hurt)).bad_checksums == protected


@pytest.mark.parametrize("mode", [0, 3])
def test_tables_after_the_side_information_of_either_mode(mode):
    frame, side, _ = made(3, mode, protected=False)
    body = frame * 7
    total = len(frame) + len(body)
    seek = bytes(min(255, 256 * (len(frame) + len(frame) * (k * 7 // 100)) // total) for k in range(100))
    table = b"Info" + (15).to_bytes(4, "big") + (7).to_bytes(4, "big") + total.to_bytes(4, "big") + seek + (9).to_bytes(4, "big")
    info = bytearray(frame)
    info[4 + side : 4 + side + len(table)] = table
    got = media.parse(bytes(info) + body)
    assert got.table == {"frames": 7, "bytes": total, "quality": 9} and got.seek == seek and got.agrees
    info[4 + side + 20] ^= 1
    assert not media.parse(bytes(info) + body).agrees


def test_the_other_kind_of_table():
    frame, _, _ = made(3, 0, protected=False)
    sizes = [made(3, 0, bitrate=b, protected=False)[0] for b in (3, 5, 7, 5, 3)]
    body = b"".join(sizes)
    total = len(frame) + len(body)
    entries = [len(sizes[0]) + len(sizes[1]), len(sizes[2]) + len(sizes[3]), len(sizes[4])]
    table = b"VBRI" + bytes((0, 1, 0, 0)) + (75).to_bytes(2, "big") + total.to_bytes(4, "big") + (5).to_bytes(4, "big")
    table += b"".join(x.to_bytes(2, "big") for x in (3, 1, 2, 2, *entries))
    info = bytearray(frame)
    info[36 : 36 + len(table)] = table
    got = media.parse(bytes(info) + body)
    assert (got.table["frames"], got.table["bytes"], got.table["quality"], len(got.offsets), got.agrees) == (5, total, 75, 5, True)
    info[36 + 27] ^= 1
    assert not media.parse(bytes(info) + body).agrees


@pytest.mark.parametrize("version", [2, 3, 4])
def test_tags_of_every_version_and_encoding(version):
    frame = made(3, 1)[0] * 3
    for code, name in enumerate(("latin-1", "utf-16", "utf-16-be", "utf-8")):
        title = "Größe ÿ"
        body = bytes([code]) + title.encode(name)
        long = "x" * 200  # a size over 127 bytes tells plain numbers from seven-bit ones
        size = lambda n: media._synchsafe(n) if version == 4 else n.to_bytes(3 if version == 2 else 4, "big")
        ids = (b"TP1", b"TT2") if version == 2 else (b"TPE1", b"TIT2")
        rest = b"" if version == 2 else b"\0\0"
        parts = ids[0] + size(201) + rest + b"\0" + long.encode() + ids[1] + size(len(body)) + rest + body
        tag = b"ID3" + bytes((version, 0, 0)) + media._synchsafe(len(parts) + 20) + parts + bytes(20)
        got = media.parse(tag + frame)
        assert got.tags == {ids[0].decode(): long, ids[1].decode(): title} and len(got.offsets) == 3 and got.skipped == 0


def test_the_tag_at_the_end():
    frame = made(3, 3)[0] * 4
    old = b"TAG" + b"A title".ljust(30, b"\0") + b"Someone".ljust(30) + bytes(30) + b"2001" + bytes(30) + b"\x0c"
    got = media.parse(frame + old)
    assert got.tags == {"TIT2": "A title", "TPE1": "Someone", "TYER": "2001"}
    assert len(got.offsets) == 4 and got.skipped == 0
    assert media.parse(old).tags["TIT2"] == "A title" and media.parse(b"TAG").tags == {}


def test_checksum():
    assert media.crc16(b"123456789") == 0xAEE7  # the catalogued value of these parameters


def test_query(spark):
    rows = [(1, None), (2, ""), (3, "é" * 400), (3, "é" * 400), (None, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = media.read(media.store(docs)).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "", 2: "", 3: "é" * 400, None: "z" * 100_000}[r.doc_id].encode()
        payload = media.padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.table_agrees and not r.bad_checksums
    assert len({r.media_sha256 for r in got}) == 3
    assert media.read(media.store(docs.limit(0))).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.read(nothing).first().n_frames == 0
