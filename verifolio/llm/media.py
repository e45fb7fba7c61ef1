"""GIF media columns: an LZW coder and decoder, a frame compositor and feature columns.

``decode`` reads a GIF stream whole: global and local palettes, interlacing, graphic
control extensions (delay, transparency, disposal), and skips other extensions. Frames
are composited on the logical screen under the disposal rules: 0 and 1 leave the frame,
2 clears its rectangle, 3 restores what was there before.

LZW strings are decoded without a string table: the entry that a code adds is the output of
the code before it with one more byte, so lengths and sources of all output bytes follow by
pointer jumping over arrays.

The payload columns store any text as a timed animation, 192 samples to a row and
``FRAME_ROWS`` rows to a frame, and read it back from the composited screens. A sample is a
palette index; the palette gives every index another colour. UTF-8 never holds byte 255,
which is the transparent index: a sample that already stands on the screen is written as
transparent. Disposals take turns (leave, clear, restore), so what is on the screen, and with
it the payload, is right only under all of these rules. The feature is the number of frames,
their time, and 16-bin histograms of the colours shown.

Defined results: null and empty text are one row of blanks (192 bytes); equal texts give
equal files and values; other columns are ignored. Bytes that hold 255 are stored without
transparency. A damaged stream, or one whose screen or frames ask for more than ``MAX_PIXELS``
pixels, raises ``ValueError`` in ``decode`` and gives null columns in ``decode_columns``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, binaries

WIDTH = 192
#: Rows of a payload frame, time that it is shown, and disposals that take turns.
FRAME_ROWS = 64
DELAY_MS = 40
DISPOSALS = (1, 2, 3)
CLEAR_INDEX = 255
MAX_PIXELS = 1 << 24
#: A colour for each index: red tells it, green and blue vary with it.
PALETTE = bytes(v for i in range(256) for v in (i, 255 - i, 37 * i & 255))
_COLOURS = np.frombuffer(PALETTE, np.uint8).reshape(-1, 3)
_LIMIT = 4096


_SCHEDULES: dict[int, np.ndarray] = {}


def _schedule(bits: int) -> np.ndarray:
    """Widths of the codes that follow a clear code, for a minimum code size.

    The decoder knows one entry less than the encoder: after reading k codes it has made
    k - 1 entries, and widens when the next entry would not fit."""
    if bits not in _SCHEDULES:
        first = (1 << bits) + 2
        made = np.maximum(np.arange(_LIMIT + 2) - 1, 0)
        size = np.minimum(first + made, _LIMIT - 1)
        _SCHEDULES[bits] = np.maximum(np.floor(np.log2(size)).astype(np.int64) + 1, bits + 1)
    return _SCHEDULES[bits]


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths as bits, least significant first: a code touches three
    bytes at most, and no two codes share a bit, so sums put them together."""
    ends = np.cumsum(widths)
    begins = ends - widths
    lanes = codes << (begins & 7)
    at = begins >> 3
    size = (int(ends[-1]) + 7 >> 3) + 2
    out = np.bincount(at, lanes & 255, size) + np.bincount(at + 1, lanes >> 8 & 255, size) + np.bincount(at + 2, lanes >> 16, size)
    return out.astype(np.uint8)[:-2].tobytes()


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """GIF's variable-width LZW with a clear code first and whenever the table is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    schedule = _schedule(bits)
    codes: list[int] = [clear]
    starts: list[int] = [0]
    table: dict[int, int] = {}
    get = table.get
    put = codes.append
    following = end + 1
    if samples:
        prefix = samples[0]
        for sample in memoryview(samples)[1:]:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            prefix = sample
            if following < _LIMIT:
                table[key] = following
                following += 1
            else:
                starts.append(len(codes))
                put(clear)
                table.clear()
                following = end + 1
        put(prefix)
    put(end)
    array = np.array(codes, np.int64)
    at = np.array(starts)
    since = np.arange(len(array)) - np.repeat(at, np.diff(np.append(at, len(array))))
    widths = np.empty(len(array), np.int64)
    inside = since > 0
    widths[inside] = schedule[since[inside] - 1]
    widths[0] = bits + 1
    for start in starts[1:]:
        widths[start] = schedule[min(since[start - 1], _LIMIT)]
    return _packed(array, widths)


_ENDS: dict[int, np.ndarray] = {}


def _expanded(codes: np.ndarray, first: int) -> np.ndarray:
    """Samples of the codes between two clear codes; table entries begin at ``first``."""
    m = len(codes)
    # entry first + j was made of the string of code j and one more byte
    source = np.where(codes >= first, codes - first, -1)
    if (source >= np.arange(m)).any() or ((codes < first) & (codes >= first - 2)).any():
        raise ValueError("a code that no table entry has")
    size = np.append((source >= 0).astype(np.int64), 0)
    at = np.append(np.where(source < 0, m, source), m)
    while (at < m).any():
        size = size + size[at]
        at = at[at]
    size = size[:m] + 1
    begins = np.cumsum(size) - size
    own = np.repeat(np.arange(m), size)
    place = np.arange(len(own))
    whence = np.where(source[own] >= 0, begins[source[own]] + place - begins[own], place)
    while True:
        further = whence[whence]
        if np.array_equal(further, whence):
            return codes[own[whence]].astype(np.uint8)
        whence = further


def lzw_decode(data: bytes, bits: int, expected: int | None = None) -> bytes:
    """Samples of a code stream; reading stops at the end code or after ``expected`` ones."""
    clear, end = 1 << bits, (1 << bits) + 1
    schedule = _schedule(bits)
    if bits not in _ENDS:
        _ENDS[bits] = np.cumsum(schedule)
    ends = _ENDS[bits]
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total = 8 * len(data)
    out: list[np.ndarray] = []
    made, at, done = 0, 0, False

    def read(begins: np.ndarray, widths: np.ndarray) -> np.ndarray:
        first = begins >> 3
        return (stream[first] | stream[first + 1] << 8 | stream[first + 2] << 16) >> (begins & 7) & (1 << widths) - 1

    while not done and at + bits + 1 <= total:
        # the codes up to the next clear code have widths that are known beforehand; a table
        # that stays full keeps them at 12 bits
        count = int(np.searchsorted(ends, total - at, side="right"))
        codes = read(at + ends[:count] - schedule[:count], schedule[:count])
        stop = np.nonzero((codes == clear) | (codes == end))[0]
        if not len(stop) and count == len(schedule):
            more = (total - at - int(ends[-1])) // 12
            codes = np.concatenate([codes, read(at + int(ends[-1]) + 12 * np.arange(more), np.full(more, 12))])
            stop = np.nonzero((codes == clear) | (codes == end))[0]
        size = int(stop[0]) if len(stop) else len(codes)
        if size:
            out.append(_expanded(codes[:size], end + 1))
            made += len(out[-1])
        if not len(stop) or (expected is not None and made >= expected):
            break
        at += int(ends[size]) if size < len(ends) else int(ends[-1]) + 12 * (size + 1 - len(ends))
        done = int(codes[size]) == end
    found = b"".join(x.tobytes() for x in out)
    return found if expected is None else found[:expected]


def _blocks(data: bytes) -> bytes:
    """Data in sub-blocks of at most 255 bytes, with the closing empty one."""
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


@dataclass
class Frame:
    """A composited frame: RGBA pixels of the whole screen, and the samples as stored."""

    rgba: np.ndarray
    indexes: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


def encode(frames: list[np.ndarray], delay_ms: int = DELAY_MS) -> bytes:
    """Frames of 8-bit samples (rows of one width) as a timed GIF89a animation, from whose
    composited screens they can be read back."""
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), PALETTE]
    transparent = not any((f == CLEAR_INDEX).any() for f in frames)
    screen = np.full((height, width), -1, np.int16) if len(frames) > 1 else None
    for k, frame in enumerate(frames):
        disposal, (h, w) = DISPOSALS[k % len(DISPOSALS)], frame.shape
        written = frame
        if screen is not None:
            before = screen[:h, :w].copy()
            if transparent:
                written = np.where(before == frame, CLEAR_INDEX, frame)
            if disposal == 1:
                screen[:h, :w] = frame
            elif disposal == 2:
                screen[:h, :w] = -1
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | transparent, delay_ms // 10, CLEAR_INDEX if transparent else 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, w, h, 0))
        out.append(b"\x08" + _blocks(lzw_encode(np.ascontiguousarray(written, np.uint8).tobytes())))
    return b"".join(out) + b"\x3b"


def _rows_of(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and composited frames of a GIF stream."""
    width, height, frames = frames_of(data)
    return width, height, list(frames)


def frames_of(data: bytes) -> tuple[int, int, Iterator[Frame]]:
    """Width and height, and the frames one by one, so that only one screen is held."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    if len(data) < 13:
        raise ValueError("the stream ends early")
    width, height = struct.unpack_from("<HH", data, 6)
    if width * height > MAX_PIXELS:
        raise ValueError("the screen is too large")

    def run() -> Iterator[Frame]:
        try:
            yield from _frames(data, width, height)
        except (IndexError, struct.error) as error:
            raise ValueError("the stream ends early") from error

    return width, height, run()


def _frames(data: bytes, width: int, height: int) -> Iterator[Frame]:
    flags, at = data[10], 13
    shared = None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = data[at : at + size], at + size
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None

    def chained(at: int) -> tuple[bytes, int]:
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += 1 + size
        return b"".join(parts), at + 1

    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = chained(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MAX_PIXELS:
            raise ValueError("a frame is too large")
        at += 10
        palette = shared
        if flags & 0x80:
            size = 3 << ((flags & 7) + 1)
            palette, at = data[at : at + size], at + size
        bits = data[at]
        if not 2 <= bits <= 8:
            raise ValueError("a code size out of range")
        body, at = chained(at + 1)
        samples = lzw_decode(body, bits, w * h)
        if len(samples) < w * h:
            raise ValueError("too few samples")
        indexes = np.empty((h, w), np.uint8)
        indexes[_rows_of(h, bool(flags & 0x40))] = np.frombuffer(samples, np.uint8).reshape(h, w)
        if palette is None:
            raise ValueError("no palette")
        colours = np.zeros((256, 4), np.uint8)
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        colours[: len(table), :3], colours[:, 3] = table, 255
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        part = indexes[: region.shape[0], : region.shape[1]]
        if clear_index is None or not (drawn := part != clear_index).any():
            if clear_index is None:
                region[:] = colours[part]
        elif drawn.all():
            region[:] = colours[part]
        else:
            region[drawn] = colours[part[drawn]]
        yield Frame(canvas.copy(), indexes, delay, disposal, clear_index)
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def pack_payload(text: bytes) -> bytes:
    """The text, padded with blanks to a positive multiple of the row width, as a GIF."""
    padded = text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")
    rows = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    return encode([rows[i : i + FRAME_ROWS] for i in range(0, len(rows), FRAME_ROWS)])


def unpack_payload(data: bytes) -> tuple[bytes, int, int, list[list[int]]]:
    """The samples that the screens show, in order, the number of frames, their time, and
    histograms of the shown colours. A frame's own rows are those of the screen that it covers."""
    samples, count, time = [], 0, 0
    kinds = np.zeros(256, np.int64)
    for frame in frames_of(data)[2]:
        h, w = frame.indexes.shape
        red = np.ascontiguousarray(frame.rgba[:h, :w, 0])
        samples.append(red.tobytes())
        shown = frame.rgba[..., 3] > 0
        kinds += np.bincount(red.ravel() if shown.all() and shown.shape == red.shape else frame.rgba[..., 0][shown], minlength=256)
        count, time = count + 1, time + frame.delay_ms
    return b"".join(samples), count, time, [np.bincount(_COLOURS[:, c] >> 4, kinds, 16).astype(np.int64).tolist() for c in range(3)]


def histogram(samples: np.ndarray, bins: int = 16) -> list[int]:
    """Counts of 8-bit samples in equal bins."""
    return np.bincount(samples.ravel().astype(np.int64) * bins // 256, minlength=bins).tolist()


_PAYLOAD = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _payload_row(text: bytes) -> tuple:
    media = pack_payload(text)
    payload, frames, time, colours = unpack_payload(media)
    return (
        len(text),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-16:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        f"frames={frames};ms={time};" + ";".join(f"{name}={','.join(map(str, c))}" for name, c in zip(("red", "green", "blue"), colours)),
    )


def payload_columns(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns named in ``keep``, then what storing each text as a GIF gives."""
    return append_columns(docs, keep, F.col(text_col), _PAYLOAD, lambda: lambda texts: list(zip(*map(_payload_row, binaries(texts)))))


FRAME_COLUMNS = (
    "frame int, start_ms long, delay_ms long, disposal int, width int, height int, rgba binary, "
    "red array<long>, green array<long>, blue array<long>, opaque long"
)


def decode_columns(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per frame of a table of GIF streams: when it starts, its pixels on the whole
    screen, and 16-bin histograms of the opaque pixels' colours. A null or damaged stream
    gives one row with null frame columns."""
    names = [x.split(" ", 1)[0] for x in FRAME_COLUMNS.split(", ")]

    def rows_of(data: bytes | None) -> list[dict]:
        try:
            w, h, frames = decode(data or b"")
        except ValueError:
            return [dict.fromkeys(names)]
        out, start = [], 0
        for i, f in enumerate(frames):
            seen = f.rgba[f.rgba[..., 3] > 0]
            values = (i, start, f.delay_ms, f.disposal, w, h, f.rgba.tobytes(), *(histogram(seen[:, c]) for c in range(3)), len(seen))
            out.append(dict(zip(names, values)))
            start += f.delay_ms
        return out

    fields = ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in FRAME_COLUMNS.split(", ")))
    nested = append_columns(media, {"id": F.col(id_col)}, F.col(data_col), f"frames array<struct<{fields}>>", lambda: lambda data: [[rows_of(x) for x in data.to_pylist()]])
    return nested.select("id", F.explode("frames").alias("f")).select("id", "f.*")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and the payload columns for every row of docs."""
    return payload_columns(docs, {"doc_id": F.col("doc_id")})
