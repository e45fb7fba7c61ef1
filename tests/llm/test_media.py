import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verifolio.llm import media


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_payload_comes_back(text):
    payload, frames, time, _ = media.unpack_payload(media.pack_payload(text))
    assert payload == text.ljust(max(1, -(-len(text) // 192)) * 192, b" ") and (frames, time) == (1, 40)


# --- A second decoder, by loops, to compare with ------------------------------------------


def slow_lzw(data, bits):
    clear, end = 1 << bits, (1 << bits) + 1
    value, out = int.from_bytes(data, "little"), []
    width, table, last = bits + 1, [], None
    while True:
        code, value = value & (1 << width) - 1, value >> width
        if code == end:
            return [x for s in out for x in s]
        if code == clear:
            width, table, last = bits + 1, [(i,) for i in range(clear)] + [(), ()], None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out.append(entry)
        last = entry


def slow_screens(data):
    """Every frame's screen as rows of colours (None where nothing is), its size and delay."""
    width, height = struct.unpack_from("<HH", data, 6)
    palette, at = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(256)], 13 + 768
    screen, out, control = [[None] * width for _ in range(height)], [], None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            control = (data[at + 3] >> 2 & 7, int.from_bytes(data[at + 4 : at + 6], "little") * 10, data[at + 6] if data[at + 3] & 1 else None)
            at += 8
            continue
        left, top, w, h, _ = struct.unpack_from("<HHHHB", data, at + 1)
        bits, at, body = data[at + 10], at + 11, b""
        while data[at]:
            body, at = body + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        samples, before = slow_lzw(body, bits), [list(r) for r in screen]
        for i, x in enumerate(samples):
            if x != control[2]:
                screen[top + i // w][left + i % w] = palette[x]
        out.append(([list(r) for r in screen], w, h, control[1]))
        if control[0] == 2:
            for y in range(h):
                screen[top + y][left : left + w] = [None] * w
        elif control[0] == 3:
            screen = before
    return out


@pytest.mark.parametrize("text", [b"", b"short", b"the same line again now " * 1500, bytes(i * 7 % 255 for i in range(40000)), b"\xff" + b"z" * 30000])
def test_contract_columns_against_a_slow_decoder(text):
    padded = text.ljust(max(1, -(-len(text) // 192)) * 192, b" ")
    n_bytes, payload_bytes, sha, tail, media_bytes, media_sha, feature = media._payload_row(text)
    stored = media.pack_payload(text)
    screens = slow_screens(stored)
    back = bytes(c[0] for rows, w, h, _ in screens for r in rows[:h] for c in r[:w])
    assert back == padded and n_bytes == len(text) and payload_bytes == len(padded)
    assert (sha, tail) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert (media_bytes, media_sha) == (len(stored), hashlib.sha256(stored).hexdigest())
    bins = [[0] * 16 for _ in range(3)]
    for rows, *_ in screens:
        for colour in (c for r in rows for c in r if c):
            for k in range(3):
                bins[k][colour[k] >> 4] += 1
    shown = ";".join(f"{n}={','.join(map(str, b))}" for n, b in zip(("red", "green", "blue"), bins))
    assert feature == f"frames={len(screens)};ms={40 * len(screens)};{shown}"
    if text.startswith(b"the same"):
        controls = [f.disposal for f in media.decode(stored)[2]]
        assert controls[:3] == [1, 2, 3][: len(controls)] and any((f.indexes == 255).any() for f in media.decode(stored)[2][1:])


def test_crafted_headers_are_bounded():
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    with pytest.raises(ValueError):
        media.decode(huge)
    with pytest.raises(ValueError):
        media.decode(gif(1, 1, PALETTE, struct.pack("<BHHHHB", 0x2C, 0, 0, 65535, 65535, 0) + b"\x02\x00"))


def test_code_beyond_the_table():
    codes = [256, 65, 300, 257]
    stream = sum(c << 9 * i for i, c in enumerate(codes)).to_bytes(5, "little")
    with pytest.raises(ValueError):
        media.lzw_decode(stream, 8)


@pytest.mark.parametrize("data", [b"ab" * 60000, bytes(200000), np.random.default_rng(1).integers(0, 256, 90000, np.uint8).tobytes()])
def test_full_tables(data):
    assert media.lzw_decode(media.lzw_encode(data), 8) == data


@pytest.mark.parametrize("bits", [2, 4, 7])
def test_small_code_sizes(bits):
    data = np.random.default_rng(bits).integers(0, 1 << bits, 20000, np.uint8).tobytes()
    assert media.lzw_decode(media.lzw_encode(data, bits), bits) == data


def test_published_example():
    """The code stream of the well-known 10 by 10 sample image of the GIF format."""
    codes = bytes.fromhex("8c2d99872a1cdc33a0027 5ec95faa8de608c04914c01".replace(" ", ""))
    rows = [[1] * 5 + [2] * 5] * 3 + [[1] * 3 + [0] * 4 + [2] * 3] * 2 + [[2] * 3 + [0] * 4 + [1] * 3] * 2 + [[2] * 5 + [1] * 5] * 3
    assert media.lzw_decode(codes, 2, 100) == bytes(x for r in rows for x in r)


def test_deferred_clear_code():
    """A stream may keep a full table; codes then stay at 12 bits."""
    data = np.random.default_rng(4).integers(0, 256, 9000, np.uint8).tobytes()
    table, codes, prefix = {}, [256], data[0]
    following = 258
    for b in data[1:]:
        code = table.get((prefix, b))
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        if following < 4096:
            table[prefix, b] = following
            following += 1
        prefix = b
    codes += [prefix, 257]
    bits, made, width = 0, 0, 9
    out = at = 0
    for i, c in enumerate(codes):
        out |= c << at
        at += width
        made = max(i - 1, 0)
        width = min(max((258 + made).bit_length(), 9), 12)
    stream = out.to_bytes(-(-at // 8), "little")
    del bits
    assert media.lzw_decode(stream, 8, len(data)) == data


def frame(samples, left, top, width, height, disposal=0, clear=None, delay=5, palette=b"", interlace=False):
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
    flags = (0x81 if palette else 0) | (0x40 if interlace else 0)
    head = struct.pack("<BHHHHB", 0x2C, left, top, width, height, flags)
    return control + head + palette + b"\x02" + media._blocks(media.lzw_encode(bytes(samples), 2))


def gif(width, height, palette, *frames):
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette + b"".join(frames) + b"\x3b"


RED, GREEN, BLUE, WHITE = b"\xff\0\0", b"\0\xff\0", b"\0\0\xff", b"\xff\xff\xff"
PALETTE = RED + GREEN + BLUE + WHITE


def shown(f):
    names = {tuple(RED): "r", tuple(GREEN): "g", tuple(BLUE): "b", tuple(WHITE): "w"}
    return ["".join(names[tuple(p[:3])] if p[3] else "." for p in row) for row in f.rgba.tolist()]


def test_disposal_transparency_and_palettes():
    data = gif(
        3,
        2,
        PALETTE,
        frame([0] * 6, 0, 0, 3, 2, disposal=1),
        frame([1, 3, 3, 1], 0, 0, 2, 2, disposal=2, clear=3),
        frame([2], 2, 1, 1, 1, disposal=3),
        frame([0], 1, 1, 1, 1, disposal=0, palette=WHITE + RED + RED + RED),
    )
    width, height, frames = media.decode(data)
    assert (width, height) == (3, 2)
    assert [shown(f) for f in frames] == [["rrr", "rrr"], ["grr", "rgr"], ["..r", "..b"], ["..r", ".wr"]]
    assert [f.delay_ms for f in frames] == [50] * 4


def test_interlaced_rows():
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    samples = [r % 4 for r in order]
    _, _, frames = media.decode(gif(1, 10, PALETTE, frame(samples, 0, 0, 1, 10, interlace=True)))
    assert frames[0].indexes[:, 0].tolist() == [r % 4 for r in range(10)]


def test_many_rows_go_on_in_further_frames(monkeypatch):
    monkeypatch.setattr(media, "FRAME_ROWS", 2)
    payload, frames, time, _ = media.unpack_payload(media.pack_payload(b"x" * 1000))
    assert (frames, time) == (3, 120) and payload == (b"x" * 1000).ljust(1152)


def test_damaged_streams(spark):
    good = gif(1, 1, PALETTE, frame([1], 0, 0, 1, 1))
    rows = [(1, good), (2, good[:20]), (3, b"no gif"), (4, None), (5, b"")]
    found = media.decode_columns(spark.createDataFrame(rows, "k long, b binary"), "k", "b").collect()
    by = {r.id: r for r in found}
    assert len(found) == 5 and by[1].rgba == bytes([0, 255, 0, 255]) and by[1].green[15] == 1
    assert all(by[i].frame is None for i in (2, 3, 4, 5))


def test_documents_and_odd_rows(documents, odd, odd_rows, none):
    rows = [r[:2] for r in odd_rows] + [tuple(r) for r in documents.select("doc_id", "text").limit(30).collect()]
    found = media.media_columns(odd).collect() + media.media_columns(documents.limit(30)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in [r[:2] for r in odd_rows]:
        raw = (text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = by[doc_id][0]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
    assert media.media_columns(none).count() == 0
