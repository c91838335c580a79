"""GIF media columns: LZW code streams, palettes, disposal, transparency and timed frames.

`decode` reads GIFs: it follows the extension and image blocks and decodes the frames' LZW streams (codes that grow
from the minimum size to 12 bits), and `composed` draws the frames on the canvas with their palettes, transparency and disposal.
`encode` stores 8-bit samples as frames of one canvas with a colour palette: the first frame is whole, and in the others a sample
that equals what the canvas shows there is transparent, so only drawing the frames in order gives the samples back.

Many streams are coded at once. The encoder goes through all of them side by side, a sample of each at a time, with one hash
table of (code, sample) for each. The decoder reads all codes, as their widths follow from their places, and takes
a table entry for what it is: the output of one code and the first sample of the next. So each sample
of the output points at an earlier one, and pointers are followed until they meet a plain code.

Media columns of a text: its UTF-8 bytes filled with spaces to a multiple of 192 are the samples, 192 a row, at most 16 rows
a frame. The columns hold digests of what is read back from the canvas, and the timed frames with their colour histograms.

Edge cases: null and empty texts are one row of spaces; very long texts have many frames; equal texts have equal columns; repeated
rows are stored each; an empty table gives an empty result. Samples of 255 (none in UTF-8) switch transparency off for their
text. Other columns are ignored. Damaged files raise ValueError in `decode`, and are a row
with an error in `frame_rows`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clauseframe.llm import textcore as tc

ROW, ROWS, DELAY = 192, 16, 10
TOGETHER = 2048  # streams that are coded side by side
BLOCK_BYTES = 2 << 20
MOST_CODE = 4096
UNSEEN = 255  # the transparent sample
_I = np.arange(256, dtype=np.uint8)
#: Every sample has a colour of its own, which its red tells.
PALETTE = np.stack([_I, _I * np.uint8(37), 255 - _I], axis=1)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    indices: np.ndarray


@dataclass
class Gif:
    width: int
    height: int
    background: int
    frames: list[Frame]


def _sub_blocks(data: bytes) -> bytes:
    """Blocks of at most 255 bytes, each after its length, and an empty one."""
    whole = len(data) // 255
    body = np.empty((whole, 256), dtype=np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, dtype=np.uint8, count=255 * whole).reshape(whole, 255)
    rest = data[255 * whole :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _width(place: np.ndarray, least: int) -> np.ndarray:
    """Bits of the code at a place after a clear code: enough for the table as it is then, at most 12."""
    size = (1 << least) + 2 + np.maximum(place - 1, 0)
    return np.clip(np.frexp(size)[1], least + 1, 12)


def lzw_encode(streams: list[np.ndarray]) -> list[bytes]:
    """Codes of non-empty streams of 8-bit samples, from 9 to 12 bits; a table is cleared when it is full."""
    out = []
    for at in range(0, len(streams), TOGETHER):
        out += _encoded(streams[at : at + TOGETHER])
    return out


def _encoded(streams: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(s) for s in streams])
    order = np.argsort(-sizes, kind="stable")  # those that still go on are always the first
    n, longest = len(streams), int(sizes.max())
    size = sizes[order]
    flat = np.concatenate([streams[i] for i in order]).astype(np.int64)
    begin = np.cumsum(size) - size
    slots = 4096 if longest <= 3072 else 8192
    table = np.zeros(n * slots, dtype=np.uint32)  # code << 8 | sample, and in the lower 12 bits the code of both
    home = np.arange(n) * slots
    # at most a code for each sample, one clear code for each 3,000 and at the beginning, and the end code
    room = size + size // 3000 + 3
    put = np.cumsum(room) - room
    first = put.copy()
    codes = np.zeros(int(room.sum()), dtype=np.uint16)
    codes[put] = 256
    put += 1
    following = np.full(n, 258)
    now = flat[begin].copy()
    going = np.searchsorted(-size, -np.arange(1, longest), side="left")  # how many have a sample at each place
    for k, m in enumerate(going.tolist(), 1):
        sample = flat[begin[:m] + k]
        key = now[:m] << 8 | sample
        slot = home[:m] + ((key * 40503 >> 4) & (slots - 1))
        held = table[slot]
        same = (held >> 12 == key) & (held > 0)
        look = np.flatnonzero(~same & (held > 0))
        while len(look):  # another key's place: the next one
            at = slot[look] + 1
            at = np.where(at == home[look] + slots, home[look], at)
            slot[look] = at
            got = table[at]
            held[look] = got
            same[look] = (got >> 12 == key[look]) & (got > 0)
            look = look[(got > 0) & ~same[look]]
        new = np.flatnonzero(~same)
        codes[put[new]] = now[new]
        put[new] += 1
        full = new[following[new] == MOST_CODE] if k > MOST_CODE - 260 else new[:0]
        if len(full):
            codes[put[full]] = 256
            put[full] += 1
            table.reshape(n, slots)[full] = 0
            following[full] = 257
        fresh = new if not len(full) else new[following[new] > 257]
        table[slot[fresh]] = key[fresh] << 12 | following[fresh]
        following[new] += 1
        now[:m] = held & 4095
        now[new] = sample[new]
    codes[put], codes[put + 1] = now, 257
    counts = put + 2 - first
    # the place of each code after the last clear code gives its width
    where = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    code = codes[where]
    index = np.arange(len(code))
    clear = code == 256
    since = index - np.maximum.accumulate(np.where(clear, index, 0)) - 1
    heads = np.cumsum(counts) - counts
    before = np.empty(len(code), dtype=np.int64)  # a clear code is as wide as any code in its place
    before[1:], before[0] = since[:-1] + 1, 0
    before[heads] = 0
    width = _width(np.where(clear, before, since), 8)
    total = np.add.reduceat(width, heads)
    # fill each stream to whole bytes by a code of no more than 7 zero bits
    ends = np.cumsum(counts)
    code, width = np.insert(code, ends, 0), np.insert(width, ends, -total % 8)
    bits = np.unpackbits(code.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    data = np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()
    to = np.cumsum((total + 7) // 8)
    out: list[bytes] = [b""] * n
    for i, a, b in zip(order.tolist(), [0, *to[:-1].tolist()], to.tolist()):
        out[i] = data[a:b]
    return out


def _codes(streams: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes of all streams but clear and end codes, in order: the stream, the code, and the index of the first code with the same table."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    data = np.frombuffer(b"".join(streams) + bytes(4), dtype=np.uint8).astype(np.uint32)
    stop = np.cumsum(sizes) * 8
    at, place = stop - sizes * 8, np.zeros(len(sizes), dtype=np.int64)  # the next bit, and its place after the last clear code
    tables = np.zeros(len(sizes), dtype=np.int64)
    clear = 1 << least
    wide = np.concatenate([[0], np.cumsum(_width(np.arange(MOST_CODE + 1), least))])
    bit = lambda p: wide[np.minimum(p, MOST_CODE)] + 12 * np.maximum(p - MOST_CODE, 0)
    live, got, most = np.arange(len(sizes)), [], 1  # a stream mostly begins with a clear code
    while len(live):
        count = np.minimum((stop[live] - at[live]) // (least + 1), most)
        live, count = live[count > 0], count[count > 0]
        if not len(live):
            break
        heads = np.cumsum(count) - count
        k = np.arange(int(count.sum())) - np.repeat(heads, count)
        s = np.repeat(live, count)
        p = place[s] + k
        pos, width = at[s] + bit(p) - bit(place[s]), _width(np.minimum(p, MOST_CODE), least)
        byte = np.minimum(pos >> 3, len(data) - 3)
        code = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (pos & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        over = pos + width > stop[s]
        mark = (code == clear) | (code == clear + 1) | over
        first = np.minimum.reduceat(np.where(mark, k, 1 << 30), heads)
        keep = k < np.repeat(first, count)
        got.append((s[keep], tables[s[keep]], code[keep].astype(np.int64)))
        hit = first < count
        here = heads + np.minimum(first, count - 1)
        again = hit & (code[here] == clear) & ~over[here]
        at[live] = pos[here] + width[here]
        place[live] = np.where(again, 0, p[here] + 1)
        tables[live[again]] += 1
        live, most = live[again | ~hit], MOST_CODE
    s, t, code = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, dtype=np.int64),) * 3
    order = np.argsort(s, kind="stable")
    s, t, code = s[order], t[order], code[order]
    index = np.arange(len(s))
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return s, code, np.maximum.accumulate(np.where(new, index, 0)) if len(s) else index


def lzw_decode(streams: list[bytes], least: int, sizes: list[int]) -> list[np.ndarray]:
    """The first sizes[i] samples of each stream; codes start at least + 1 bits."""
    out = []
    for at in range(0, len(streams), TOGETHER):
        out += _decoded(streams[at : at + TOGETHER], least, sizes[at : at + TOGETHER])
    return out


def _decoded(streams: list[bytes], least: int, sizes: list[int]) -> list[np.ndarray]:
    stream, code, begin = _codes(streams, least)
    index = np.arange(len(code))
    plain = code < 1 << least
    # an entry is what the code at its place gave, and one sample more
    entry = np.where(plain, index, begin + code - (1 << least) - 2)
    if (entry[~plain] >= index[~plain]).any():
        raise ValueError("an LZW code is ahead of its table")
    length, jump = (~plain).astype(np.int64), entry.copy()
    while not plain[jump].all():
        length += length[jump]
        jump = jump[jump]
    length += 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    back = np.repeat((start - start[entry]).astype(np.int32), length)
    source = np.arange(total, dtype=np.int32) - back
    value = np.zeros(total, dtype=np.uint8)
    value[start[plain]] = code[plain]
    known = np.zeros(total, dtype=bool)
    known[start[plain]] = True
    todo = np.flatnonzero(~known[source])
    while len(todo):
        source[todo] = source[source[todo]]
        todo = todo[~known[source[todo]]]
    samples = value[source]
    made = np.zeros(len(streams) + 1, dtype=np.int64)
    np.add.at(made, stream + 1, length)
    at = np.cumsum(made)
    if (made[1:] < sizes).any():
        raise ValueError("an LZW stream ends early")
    return [samples[a : a + n] for a, n in zip(at[:-1].tolist(), sizes)]


def encode(payloads: list[np.ndarray], width: int = ROW, rows: int = ROWS, delay: int = DELAY) -> list[bytes]:
    """A GIF for each array of 8-bit samples; their number must be a positive multiple of `width`."""
    area, parts, frames = width * rows, [], []
    for samples in payloads:
        if not len(samples) or len(samples) % width:
            raise ValueError("the samples must fill whole rows")
        clear = not (samples == UNSEEN).any()
        shown = samples.copy()
        if clear and len(samples) > area:
            shown[area:][samples[area:] == samples[:-area]] = UNSEEN
        cut = [shown[k : k + area] for k in range(0, len(shown), area)]
        parts += cut
        frames.append((len(samples), clear, len(cut)))
    coded, at, out = lzw_encode(parts), 0, []
    for n, clear, count in frames:
        gif = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, n // width), 0xF7, 0, 0), PALETTE.tobytes()]
        for k in range(count):
            see_through = clear and k > 0
            gif += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2 | see_through, delay, UNSEEN if see_through else 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(parts[at + k]) // width, 0), b"\x08", _sub_blocks(coded[at + k])]
        at += count
        out.append(b"".join([*gif, b"\x3b"]))
    return out


def _blocks(media: bytes) -> tuple[Gif, list[tuple[int, bytes, bool]]]:
    """A GIF without samples, and for each frame the least code size, the code stream and whether it is interlaced."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", media, 6)
    at, shared = 13, None

    def palette(at, flags):
        size = 3 << ((flags & 7) + 1)
        return np.frombuffer(media, dtype=np.uint8, count=size, offset=at).reshape(-1, 3), at + size

    def sub_blocks(at):
        parts = []
        while size := media[at]:
            parts.append(media[at + 1 : at + 1 + size])
            at += size + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        shared, at = palette(at, flags)
    frames, streams, control = [], [], (0, 0, None)
    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            data, after = sub_blocks(at + 2)
            if media[at + 1] == 0xF9:
                kind, delay, index = struct.unpack_from("<BHB", data)
                control = (delay, kind >> 2 & 7, index if kind & 1 else None)
            at = after
        elif media[at] == 0x2C:
            left, top, w, h, kind = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            own = shared
            if kind & 0x80:
                own, at = palette(at, kind)
            if own is None:
                raise ValueError("a frame without a palette")
            if not 1 <= media[at] <= 8:
                raise ValueError("an unknown code size")
            data, after = sub_blocks(at + 1)
            streams.append((media[at], data, bool(kind & 0x40)))
            frames.append(Frame(left, top, w, h, *control, own, np.zeros((0, 0), dtype=np.uint8)))
            control, at = (0, 0, None), after
        else:
            raise ValueError("an unknown block")
    return Gif(width, height, background, frames), streams


def _parsed(media: bytes) -> tuple[Gif, list[tuple[int, bytes, bool]]]:
    try:
        return _blocks(media)
    except (struct.error, IndexError) as error:
        raise ValueError("the file ends early") from error


def decode(files: list[bytes]) -> list[Gif]:
    """GIFs with the samples of their frames; the streams of all files are decoded together."""
    parsed, by_size = [_parsed(m) for m in files], {}
    for gif, streams in parsed:
        for frame, (least, data, woven) in zip(gif.frames, streams):
            by_size.setdefault(least, []).append((frame, data, woven))
    for least, some in by_size.items():
        got = lzw_decode([data for _, data, _ in some], least, [f.width * f.height for f, _, _ in some])
        for (frame, _, woven), samples in zip(some, got):
            frame.indices = samples.reshape(frame.height, frame.width)
            if woven:  # rows in four passes
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, frame.height, step)]
                plain = np.empty_like(frame.indices)
                plain[order] = frame.indices
                frame.indices = plain
    return [gif for gif, _ in parsed]


def composed(gif: Gif):
    """The canvas after each frame as (frame, RGBA): transparent samples leave what is there; disposal 2 clears
    a frame's area and 3 restores what was there before."""
    canvas = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        indices = f.indices[: area.shape[0], : area.shape[1]]
        colours = np.full((256, 4), 255, dtype=np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[len(f.palette) :, :3] = f.palette[-1]
        drawn = colours[indices]
        area[...] = drawn if f.transparent is None else np.where((indices == f.transparent)[..., None], area, drawn)
        yield f, canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels of an RGBA canvas by colour: four steps of red, green and blue each."""
    pixels = np.ascontiguousarray(canvas).view("<u4").ravel()
    bins = (pixels >> 2 & 48) | (pixels >> 12 & 12) | (pixels >> 22 & 3)
    return np.bincount(bins[pixels >> 24 > 0], minlength=64)


def timed_frames(gif: Gif) -> list[tuple[int, int, int, list[int]]]:
    """(index, delay, disposal, histogram) of what is shown after each frame."""
    return [(i, f.delay, f.disposal, histogram(canvas).tolist()) for i, (f, canvas) in enumerate(composed(gif))]


def payload(data: bytes) -> np.ndarray:
    """A text's bytes as samples, with spaces to whole rows."""
    return np.frombuffer(data + b" " * (-len(data) % ROW or (0 if data else ROW)), dtype=np.uint8)


def _columns(data: bytes, media: bytes, gif: Gif) -> tuple:
    back, shown = [], []
    for i, (f, canvas) in enumerate(composed(gif)):
        back.append(canvas[: f.height, : f.width, 0].tobytes())
        shown.append({"frame": i, "delay": f.delay, "disposal": f.disposal, "histogram": histogram(canvas)})
    back = b"".join(back)
    bars = np.sum([x["histogram"] for x in shown], axis=0)
    feature = f"frames={len(shown)};centiseconds={sum(x['delay'] for x in shown)};colours={','.join(map(str, bars))}"
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, shown


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<frame:int,delay:int,disposal:int,histogram:array<int>>>"
_NAMES = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature frames".split()
_SHOWN = pa.list_(pa.struct([("frame", pa.int32()), ("delay", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int32()))]))
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _SHOWN]


def _stored(batches):
    """(ids, texts as bytes, GIFs) of a bounded number of bytes, or of one text."""
    for batch in batches:
        for at, to, data, offsets in tc.text_blocks(batch.column("text"), BLOCK_BYTES):
            raw = data.tobytes()
            texts = [raw[offsets[i] : offsets[i + 1]] for i in range(to - at)]
            yield batch.column("doc_id").slice(at, to - at), texts, encode([payload(t) for t in texts])


def _rows(batches):
    tc.release()
    for ids, texts, media in _stored(batches):
        rows = [_columns(*x) for x in zip(texts, media, decode(media))]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), _KINDS))], _NAMES)


def media_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the digests, feature and timed frames of each text's stored form."""
    return tc.text_only(docs).mapInArrow(_rows, SCHEMA)


def _files(batches):
    for ids, _, media in _stored(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary())], ["doc_id", "media"])


def media_files(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, media): the GIF of each text."""
    return tc.text_only(docs).mapInArrow(_files, "doc_id long, media binary")


_FRAME_SCHEMA = "doc_id long, frame int, delay int, disposal int, histogram array<bigint>, error string"
_FRAME_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()]


def _frames(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            doc, media = batch.column("doc_id")[i].as_py(), batch.column("media")[i].as_py()
            try:
                rows = [(doc, *shown, None) for shown in timed_frames(decode([media])[0])] if media is not None else []
            except ValueError as error:
                rows = [(doc, None, None, None, None, str(error))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _FRAME_KINDS)], "doc_id frame delay disposal histogram error".split())


def frame_rows(files: DataFrame) -> DataFrame:
    """files (doc_id, media) -> (doc_id, frame, delay, disposal, histogram, error): a row for each frame of each GIF.

    A damaged file is one row with an error and nulls; null media and files without frames have no row.
    """
    files = files.selectExpr("cast(doc_id as long) AS doc_id", "cast(media as binary) AS media")
    return files.mapInArrow(_frames, _FRAME_SCHEMA)


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(tc.read_table(spark, sf_dir, "documents"))
