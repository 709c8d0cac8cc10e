"""Chroma audio fingerprints of a media column, and their alignment.

A recording (WAV bytes, 8 or 16 bit PCM) becomes frames of twelve pitch classes; integral-image filters over a window of
frames compare areas of time and pitch class, and each gives two bits, so that every frame position has one packed 32-bit
integer. Two recordings are aligned by an offset histogram: equal 24-bit parts of their integers vote for
the offset between them, and every offset with enough votes and overlap is judged by the share of differing bits over the overlap;
the least share counts, of equal ones that with the longest overlap. Every occurrence of a part votes.

Recordings of equal fingerprints are one class. A search takes the classes that hold a query, in blocks of bounded size, against all classes:
one pass over the written fingerprints for each block, in which one row leaves a task for each class that a query of the
block aligns with, never one for each pair. No fingerprints but a block's are ever held together. The lookups of all queries in all recordings
grow with queries times recordings, as such a search must where all are alike.

The test tables have no audio, so render() makes recordings from a column of numbers: each number is a tone, as many
semitones from a middle pitch as it is thirds of the column's usual deviation.

Defined results: every recording gets one row. A null, unreadable or too short recording has no class and no links, silence likewise; repeated rows
are recordings of their own, which align with one another; a null id is never a query; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch
from palimpsest.plans.ship import ship

#: Frames: samples a second after decimation, samples of a frame and between frames, frames of a filter's window.
RATE, FRAME, HOP, WINDOW = 4000, 512, 256, 16
LOWEST, HIGHEST = 60.0, 1900.0
#: Votes of an offset; bits that may differ; frames that must overlap.
VOTES, ERRORS, OVERLAP = 3, 0.2, 48
#: Fingerprints of a block of queries, and passes whose results are put together in one step.
BLOCK, PASSES = 2000, 8


def render(values: np.ndarray, note: int = 512, deviation: float = 0.125) -> bytes:
    """A WAV recording with one tone for each number."""
    semitone = np.clip(np.nan_to_num(values.astype(float)) / deviation * 3, -24, 24)
    freq = 261.63 * 2 ** (semitone / 12)
    t = np.arange(note) / RATE
    envelope = np.minimum(1, np.minimum(np.arange(note), np.arange(note)[::-1]) / 40)
    sound = (np.sin(2 * np.pi * freq[:, None] * t[None, :]) + 0.4 * np.sin(4 * np.pi * freq[:, None] * t[None, :])) * envelope
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((sound.reshape(-1) * 12000).astype("<i2").tobytes())
    return out.getvalue()


def decode(data: bytes | None) -> np.ndarray:
    """Mono samples at RATE, or none if the recording can't be read."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0)
    if width not in (1, 2) or not rate:
        return np.zeros(0)
    x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], "<i2" if width == 2 else np.uint8).astype(float)
    x = (x - (128 if width == 1 else 0)).reshape(-1, channels).mean(axis=1)
    if rate != RATE and len(x):
        n = int(len(x) * RATE / rate)
        smooth = max(1, rate // RATE)
        x = np.convolve(x, np.ones(smooth) / smooth, "same") if smooth > 1 else x
        x = np.interp(np.arange(n) * rate / RATE, np.arange(len(x)), x)
    return x


def _pitch_classes() -> np.ndarray:
    freq = np.fft.rfftfreq(FRAME * 2, 1 / RATE)
    out = np.zeros((len(freq), 12))
    for i, f in enumerate(freq):
        if LOWEST <= f <= HIGHEST:
            p = (12 * np.log2(f / 440.0)) % 12
            lo = int(p) % 12
            out[i, lo] += 1 - (p - int(p))
            out[i, (lo + 1) % 12] += p - int(p)
    return out


_CHROMA = _pitch_classes()


def chroma(x: np.ndarray) -> np.ndarray:
    """Pitch-class frames, each of length 1 (or all 0 where it is silent), smoothed over five frames."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, FRAME * 2, axis=1)) ** 2
    c = np.sqrt(power @ _CHROMA)
    pad = np.pad(c, ((2, 2), (0, 0)), mode="edge")
    c = sum(w * pad[i : i + n] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1.0, c / np.maximum(norm, 1e-9), 0)


def _filters() -> list[tuple[int, int, int, int, int]]:
    """16 filters (shape, first row, rows, first frame, frames), by rule: all shapes, rows spread over the octave, widths alternating."""
    return [(i % 6, (5 * i) % 9, 2 + i % 2 * 2 if (5 * i) % 9 + 2 + i % 2 * 2 <= 12 else 2, (3 * i) % 4, 12 if i % 3 else 6) for i in range(16)]


FILTERS = _filters()


def fingerprint(x: np.ndarray) -> np.ndarray:
    """One uint32 for every position of the window."""
    c = chroma(x)
    n = len(c) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(y, h, x0, w):
        return image[t + x0 + w, y + h] - image[t + x0, y + h] - image[t + x0 + w, y] + image[t + x0, y]

    out = np.zeros(n, np.uint32)
    for i, (shape, y, h, x0, w) in enumerate(FILTERS):
        whole = area(y, h, x0, w)
        if shape == 0:  # against the mean of all rows
            a, b = whole, area(0, 12, x0, w) * h / 12
        elif shape == 1:  # upper against lower rows
            a, b = area(y, h // 2, x0, w), area(y + h // 2, h - h // 2, x0, w)
        elif shape == 2:  # earlier against later
            a, b = area(y, h, x0, w // 2), area(y, h, x0 + w // 2, w - w // 2)
        elif shape == 3:  # crosswise
            a = area(y, h // 2, x0, w // 2) + area(y + h // 2, h - h // 2, x0 + w // 2, w - w // 2)
            b = whole - a
        elif shape == 4:  # middle rows against those around, over the octave's border
            a, b = whole, area((y + 6) % 9, h, x0, w) if (y + 6) % 9 + h <= 12 else area(0, h, x0, w)
        else:  # middle against both ends in time
            a = area(y, h, x0 + w // 3, w // 3)
            b = (whole - a) / 2
        r = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        level = np.searchsorted([-0.25, 0.0, 0.25], r)
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * i)
    live = image[t + WINDOW, 12] - image[t, 12] > 0
    return out[live] if not live.all() else out


def parts(codes: np.ndarray) -> np.ndarray:
    """The four 24-bit parts of each integer, marked by which byte is left out (4 x n)."""
    c = codes.astype(np.int64)
    return np.stack([(c & ~(0xFF << (8 * i)) & 0xFFFFFFFF) | (i << 32) for i in range(4)])


def _chunks(size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` in total size, of one item at least."""
    end = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, end[i] - size[i] + most, "right")))
        yield i, j
        i = j


class Block:
    """Queries' fingerprints with an index of their 24-bit parts."""

    def __init__(self, ids: list, codes: list[np.ndarray]):
        self.ids, self.codes = ids, codes
        size = self.size = np.array([len(c) for c in codes], np.int64)
        self.start = np.cumsum(size) - size
        flat = self.flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        owner, place = np.repeat(np.arange(len(codes)), size), np.concatenate([np.arange(n) for n in size]) if codes else np.zeros(0, int)
        key = parts(flat).reshape(-1)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.place = key[order], np.tile(owner, 4)[order], np.tile(place, 4)[order]

    def align(self, codes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query, offset, frames of overlap, share of differing bits) for every query that matches."""
        if len(codes) < OVERLAP:
            return []
        mine, at = parts(codes).reshape(-1), np.tile(np.arange(len(codes)), 4)
        lo, hi = np.searchsorted(self.key, mine, "left"), np.searchsorted(self.key, mine, "right")
        hit = hi > lo
        if not hit.any():
            return []
        lo, n, at = lo[hit], (hi - lo)[hit], at[hit]
        wide, vote, count = 1 << 20, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in _chunks(n):
            row = np.repeat(np.arange(i, j), n[i:j])
            spot = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
            v, c = np.unique(self.owner[spot] * wide + (at[row] - self.place[spot] + wide // 2), return_counts=True)
            if len(vote):
                v, back = np.unique(np.r_[vote, v], return_inverse=True)
                c = np.bincount(back, np.r_[count, c]).astype(np.int64)
            vote, count = v, c
        vote = vote[count >= VOTES]
        q, off = vote // wide, vote % wide - wide // 2
        begin, overlap = np.maximum(0, off), np.minimum(len(codes), self.size[q] + off) - np.maximum(0, off)
        enough = overlap >= OVERLAP
        q, off, begin, overlap = q[enough], off[enough], begin[enough], overlap[enough]
        wrong = np.zeros(len(q))
        for i, j in _chunks(overlap):
            size = overlap[i:j]
            first = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(first, size)
            x = codes[np.repeat(begin[i:j], size) + step]
            y = self.flat[np.repeat(self.start[q[i:j]] + begin[i:j] - off[i:j], size) + step]
            wrong[i:j] = np.add.reduceat(np.bitwise_count(x ^ y).astype(np.int64), first) / (32 * size)
        order = np.lexsort((np.abs(off), -overlap, wrong, q))
        order = order[wrong[order] <= ERRORS]
        best = order[np.r_[True, q[order][1:] != q[order][:-1]]] if len(order) else order
        return [(int(q[i]), int(off[i]), int(overlap[i]), float(wrong[i])) for i in best]


def _print(rendered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = []
                for x in part.column(1):
                    data = x.as_py()
                    if rendered and data is not None:
                        data = render(np.array([v if v is not None else 0 for v in data], float)) if data else None
                    got.append(fingerprint(decode(data)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["id", "codes"])

    return run


def fingerprints(media: DataFrame, id_col: str, audio_col: str, rendered: bool = False) -> DataFrame:
    """(id, codes): the packed integers, little-endian. rendered: the column holds numbers for render()."""
    ship(media.sparkSession)
    src = media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio"))
    return src.mapInArrow(_print(rendered), f"id {dict(src.dtypes)['id']}, codes binary")


def _seek(held):
    """Of each class (key, codes): the queries of the block that it aligns with, and the best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, many = held.value
        for batch in batches:
            out = []
            for key, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = [(wrong, -n, abs(off), first[q], off, many[q]) for q, off, n, wrong in block.align(np.frombuffer(codes, np.uint32)) if block.ids[q] != key]
                if got:
                    wrong, n, _, query, off, _ = min(got)
                    out.append((key, sum(x[-1] for x in got), query, off, -n, wrong))
            cols = zip(*out, strict=True) if out else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "links", "query_id", "offset", "overlap", "errors"])

    return run


def search(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, links, best) of the classes (key, codes, queries, q1) that align with a query of another class: how many queries, and the best
    one as errors, overlap, offset, query_id. A block of queries at a time."""
    spark = classes.sparkSession
    some = classes.where("queries > 0")
    blocks = max(1, -(-some.count() // BLOCK))
    schema = "key string, links long, query_id long, offset int, overlap int, errors double"
    done, parts = None, []
    for b in range(blocks):
        rows = some.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "codes", "q1", "queries").orderBy("key").collect()  # about BLOCK rows
        block = Block([r["key"] for r in rows], [np.frombuffer(r["codes"], np.uint32) for r in rows])
        held = spark.sparkContext.broadcast((block, [r["q1"] for r in rows], [r["queries"] for r in rows]))
        best = F.struct("errors", (-F.col("overlap")).alias("less"), F.abs("offset").alias("far"), "query_id", "offset", "overlap")
        parts.append(classes.select("key", "codes").mapInArrow(_seek(held), schema).select("key", "links", best.alias("best")))
        if len(parts) == PASSES or b == blocks - 1:
            for x in [done] if done is not None else []:
                parts.append(x)
            every = parts[0]
            for x in parts[1:]:
                every = every.unionByName(x)
            last, parts = done, []
            done = scratch.keep(every.groupBy("key").agg(F.sum("links").alias("links"), F.min("best").alias("best")), "found")
            if last is not None:
                scratch.drop(last)
    return done


def align_recordings(media: DataFrame, id_col: str, audio_col: str, rendered: bool = False, every: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """One row for every recording: id, class_id (the smallest id of equal fingerprint), n_codes, n_links (recordings with an id divisible by
    ``every``, other than itself, that it aligns with), and the best of them: query_id, offset, overlap, errors."""
    s = scratch or Scratch(media.sparkSession)
    prints = s.keep(fingerprints(media, id_col, audio_col, rendered).select("id", "codes", F.when(F.length("codes") >= 4 * OVERLAP, F.md5("codes")).alias("key")), "fingerprints")
    asks = F.col("id") % every == 0
    grouped = prints.where("key is not null").groupBy("key").agg(F.min("id").alias("class_id"), F.count_if(asks).alias("queries"), F.min(F.when(asks, F.col("id"))).cast("long").alias("q1"), F.max(F.when(asks, F.col("id"))).cast("long").alias("q2"), F.first("codes").alias("codes"))
    classes = s.keep(grouped, "classes")
    facts = classes.drop("codes").join(search(classes, s), "key", "left")
    out = prints.select("id", "key", (F.length("codes") / 4).cast("int").alias("n_codes")).join(facts.select(F.col("key").alias("k"), "class_id", "queries", "q1", "q2", "links", "best"), F.col("key") == F.col("k"), "left")
    # Queries of its own class align with no error at offset 0.
    own = F.coalesce(F.col("queries") - F.coalesce(asks, F.lit(False)).cast("long"), F.lit(0))
    peer = F.when(F.col("q1") == F.col("id"), F.col("q2")).otherwise(F.col("q1"))
    return out.select(
        "id",
        "class_id",
        "n_codes",
        (own + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(own > 0, peer).otherwise(F.col("best.query_id")).alias("query_id"),
        F.when(own > 0, 0).otherwise(F.col("best.offset")).alias("offset"),
        F.when(own > 0, F.col("n_codes")).otherwise(F.col("best.overlap")).alias("overlap"),
        F.when(own > 0, 0.0).otherwise(F.col("best.errors")).alias("errors"),
    )
