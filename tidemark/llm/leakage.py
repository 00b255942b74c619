"""Evaluation texts leaking into training text: latent semantic retrieval, then alignment."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch

_WORD = regex.compile(r"[\w\p{M}]+")
_INVISIBLE = regex.compile(r"[­​-‏⁠﻿]")
_BROKEN = regex.compile(r"(?<=\p{L})[-‐‑]\s*\n\s*(?=\p{L})")
_GROUPED = regex.compile(r"(?<=\d)[,.](?=\d)")


@dataclass(frozen=True)
class Settings:
    """``buckets``: hashed terms. ``sketch``, ``rank``: columns of the random sketch, and kept of the
    SVD. ``block``: words a passage moves by; a passage has ``span`` blocks. ``query``, ``step``:
    length and distance of the query windows of an item. ``cosine``: least similarity of a candidate.
    ``least``: words of the item that make a leak; ``slack``: how many of them may be missing at the
    ends, where a changed word cannot be told from the passage's end. ``agree``: least share of these
    words that are the same. ``edits``: words changed, dropped or added that an alignment short of
    ``least`` may be widened over at its ends, and most words not the same in what it is widened to:
    one in ten of ``least``. ``near``: least share of the words that are the same in a passage that is
    a leak only because the item's answer stands in it, too. ``lists``, ``probes``, ``floor``: inverted
    lists of the index, how many of them a passage asks, and how near it must be to their centres.
    """

    buckets: int = 8192
    sketch: int = 160
    rank: int = 128
    block: int = 10
    span: int = 3
    query: int = 24
    step: int = 6
    cosine: float = 0.5
    least: int = 20
    slack: int = 0
    agree: float = 0.82
    edits: int = 2
    near: float = 0.75
    lists: int = 96
    probes: int = 8
    floor: float = 0.1
    query_block: int = 20_000
    seed: int = 7


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, typographic form, or hyphens at line breaks."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", text).casefold()
    t = _GROUPED.sub("", _BROKEN.sub("", _INVISIBLE.sub("", t)))
    return _WORD.findall(t)


def hashes_of(text: str | None) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words_of(text)], dtype=np.int64)


def _hash_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "words": [hashes_of(t) for t in b["text"]]})


def _chunks(batches: Iterator[pd.DataFrame], most: int = 40_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Texts gathered to about ``most`` words; a longer text comes alone."""
    ids, texts, n = [], [], 0
    for b in batches:
        for i, w in zip(b["id"], b["words"], strict=True):
            if len(w) == 0:
                continue
            if n and n + len(w) > most:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(i)
            texts.append(np.asarray(w, dtype=np.int64))
            n += len(w)
    if ids:
        yield ids, texts


def _blocks(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, the start of every block, and the number of blocks of each text."""
    lengths = np.array([len(t) for t in texts])
    per = -(-lengths // size)
    first = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), per)
    within = np.arange(per.sum()) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    return np.concatenate(texts), first + within * size, per


def block_sums(table: np.ndarray, words: np.ndarray, starts: np.ndarray, step: int = 8_000) -> np.ndarray:
    """The sum of ``table``'s rows over the words of each block, a slice at a time."""
    out = np.empty((len(starts), table.shape[1]), dtype=np.float32)
    ends = np.append(starts[1:], len(words))
    for i in range(0, len(starts), step):
        a, b = starts[i], ends[min(i + step, len(starts)) - 1]
        out[i : i + step] = np.add.reduceat(table[words[a:b]], starts[i : i + step] - a, axis=0)
    return out


def passages(sums: np.ndarray, per: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of all windows of ``span`` blocks, the text of each and its first block."""
    n = np.maximum(per - span + 1, 1)
    text = np.repeat(np.arange(len(per)), n)
    first = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    base = np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), n) + first
    vec = sums[base].copy()
    for k in range(1, span):
        has = first + k < per[text]
        vec[has] += sums[base[has] + k]
    return vec, text, first


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def query_starts(words: np.ndarray, s: Settings) -> list[int]:
    """Starts of the windows over an item; the last one ends with it."""
    if len(words) <= s.query:
        return [0]
    return list(range(0, len(words) - s.query, s.step)) + [len(words) - s.query]


def common_words(doc: np.ndarray, where: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence; ``where`` has the places of each word as bits."""
    full = (1 << n) - 1
    v = full
    for w in doc.tolist():
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def places(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def best_ends(docs: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Score and end, in document and item, of the best local alignment (match 1, all else -1) of each
    pair. All pairs go through the rows of their tables together."""
    n, most = max(len(d) for d in docs), max(len(i) for i in items)
    a = np.full((n, len(docs)), -1, dtype=np.int64)
    b = np.full((len(docs), most), -2, dtype=np.int64)
    for k, (d, i) in enumerate(zip(docs, items, strict=True)):
        a[: len(d), k] = d
        b[k, : len(i)] = i
    ramp = np.arange(most + 1, dtype=np.int32)
    row = np.zeros((len(docs), most + 1), dtype=np.int32)
    best = np.zeros((len(docs), 3), dtype=np.int64)
    every = np.arange(len(docs))
    for i in range(n):
        new = np.zeros_like(row)
        np.maximum(row[:, :-1] + np.where(b == a[i][:, None], 1, -1).astype(np.int32), row[:, 1:] - 1, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        j = new.argmax(axis=1)
        top = new[every, j]
        up = top > best[:, 0]
        best[up, 0], best[up, 1], best[up, 2] = top[up], i + 1, j[up]
        row = new
    return best


def aligned_all(docs: list[np.ndarray], items: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """Matches, start and end in the item, and in the document, of the best local alignment of each pair."""
    out = [(0, 0, 0, 0, 0)] * len(docs)
    ends = best_ends(docs, items)
    live = [k for k in range(len(docs)) if ends[k, 0]]
    if not live:
        return out
    back = best_ends([docs[k][: ends[k, 1]][::-1] for k in live], [items[k][: ends[k, 2]][::-1] for k in live])
    for k, (_, di, dj) in zip(live, back.tolist(), strict=True):
        i, j = int(ends[k, 1]), int(ends[k, 2])
        part, seg = docs[k][i - di : i], items[k][j - dj : j]
        out[k] = common_words(part, places(seg), len(seg)), j - dj, j, i - di, i
    return out


def aligned(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int, int]:
    return aligned_all([doc], [item])[0]


def past_edits(doc: np.ndarray, item: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """For 0 to ``edits`` words changed, dropped or added, the most words of the item that follow on
    from the start of both, and how many of them are the same. A word dropped or added counts only
    before an equal word."""

    def run(i: int, j: int, same: int) -> tuple[int, int, int]:
        while i < len(doc) and j < len(item) and doc[i] == item[j]:
            i, j, same = i + 1, j + 1, same + 1
        return i, j, same

    level, out = {run(0, 0, 0)}, []
    for k in range(edits + 1):
        out.append(max(((j, same) for _, j, same in level), default=(0, 0)))
        made = [(x, y, run(i + x, j + y, same), same) for i, j, same in level for x, y in ((1, 1), (0, 1), (1, 0)) if i + x <= len(doc) and j + y <= len(item)]
        level = {to for x, y, to, same in made if (x, y) == (1, 1) or to[2] > same}
    return out


def judge(doc: np.ndarray, item: np.ndarray, found: tuple[int, int, int, int, int], answer: np.ndarray, s: Settings) -> tuple[int, int, int] | None:
    """Matches, start and end in the item, if the alignment is a leak."""
    matches, a, b, c, d = found
    least = s.least - s.slack
    if b - a >= least:
        if matches >= s.agree * (b - a):
            return matches, a, b
        # A paraphrase is told by the item's answer.
        return (matches, a, b) if matches >= s.near * (b - a) and has_answer(doc, answer, s) else None
    if b - a < least // 2:
        return None
    before, after = past_edits(doc[:c][::-1], item[:a][::-1], s.edits), past_edits(doc[d:], item[b:], s.edits)
    for used in range(s.edits + 1):
        for k in range(used + 1):
            (x, left), (y, right) = before[k], after[used - k]
            same, words = matches + left + right, b + y - (a - x)
            if words >= least and words - same <= s.edits:
                return same, a - x, b + y
    return None


def has_answer(doc: np.ndarray, answer: np.ndarray, s: Settings) -> bool:
    return len(answer) > 0 and common_words(doc, places(answer), len(answer)) >= s.agree * len(answer)


def leaks_all(docs: list[np.ndarray], items: list[np.ndarray], answers: list[np.ndarray], s: Settings, batch: int = 256) -> list[tuple[int, int, int] | None]:
    """For each pair the longest leak among all its local alignments.

    After an alignment that is none, the stretch of the document it took is cut out, and what stands
    before it and after it is aligned anew; so a better alignment beside it hides no leak. A stretch
    shorter than the words a leak must share is dropped.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(docs)
    enough = s.least - s.slack - s.edits
    todo = sorted(((k, d) for k, d in enumerate(docs) if len(d) >= enough), key=lambda x: len(x[1]))
    while todo:
        more = []
        for at in range(0, len(todo), batch):
            part = todo[at : at + batch]
            for (k, doc), found in zip(part, aligned_all([d for _, d in part], [items[k] for k, _ in part]), strict=True):
                hit = judge(doc, items[k], found, answers[k], s)
                if hit is not None:
                    if out[k] is None or hit[2] - hit[1] > out[k][2] - out[k][1]:
                        out[k] = hit
                    continue
                if found[0] * 2 < enough:
                    continue
                more += [(k, rest) for rest in (doc[: found[3]], doc[found[4] :]) if len(rest) >= enough]
        todo = sorted(more, key=lambda x: len(x[1]))
    return out


def leaks(doc: np.ndarray, item: np.ndarray, s: Settings, answer: np.ndarray | None = None) -> tuple[int, int, int] | None:
    return leaks_all([doc], [item], [np.zeros(0, dtype=np.int64) if answer is None else answer], s)[0]


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of unit rows, and the centre of each row."""
    draw = np.random.default_rng(seed)
    centre = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        for j in range(len(centre)):
            if (own == j).any():
                centre[j] = x[own == j].sum(axis=0)
        centre = _unit(centre)
    return centre, (x @ centre.T).argmax(axis=1)


class Index:
    """The latent space, and the windows of the items in it."""

    def __init__(self, table: np.ndarray, items: list[tuple[int, np.ndarray]], s: Settings):
        self.s, self.table = s, table
        self.items = dict(items)
        windows = [(i, a, words[a : a + s.query]) for i, words in items if len(words) for a in query_starts(words, s)]
        self.owner = np.array([i for i, _, _ in windows])
        self.start = np.array([a for _, a, _ in windows])
        vec = [table[w % s.buckets].sum(axis=0) for _, _, w in windows]
        self.vec = _unit(np.array(vec, dtype=np.float32)) if vec else np.zeros((0, table.shape[1]), np.float32)
        #: A scratch bitmap of word hashes, and the items' words as places in it.
        self.mark = np.zeros(1 << 16, dtype=bool)
        self.low_bits = {i: w & 0xFFFF for i, w in items}
        self.centre, own = k_means(self.vec, s.lists, s.seed) if vec else (np.zeros((0, table.shape[1]), np.float32), np.zeros(0, int))
        self.members = [np.nonzero(own == j)[0] for j in range(len(self.centre))]

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, ...]]:
        """text, item, first and last block of the passages near windows of the item, and the first
        and last start of these windows."""
        s = self.s
        words, starts, per = _blocks(texts, s.block)
        vec, text, first = passages(block_sums(self.table, words % s.buckets, starts), per, s.span)
        vec = _unit(vec)
        out = []
        near = vec @ self.centre.T
        if near.shape[1] > s.probes:
            least = np.partition(near, near.shape[1] - s.probes, axis=1)[:, near.shape[1] - s.probes]
            asked = near >= np.maximum(least, s.floor)[:, None]
        else:
            asked = np.ones(near.shape, dtype=bool)
        for j, own in enumerate(self.members):
            rows = np.nonzero(asked[:, j])[0]
            if len(rows) and len(own):
                p, w = np.nonzero(vec[rows] @ self.vec[own].T >= s.cosine)
                if len(p):
                    p, w = rows[p], own[w]
                    out.append(np.stack([text[p], self.owner[w], first[p], self.start[w]], axis=1))
        if not out:
            return []
        rows = np.concatenate(out)
        rows = rows[np.lexsort(rows.T[::-1])]
        gap = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0) | (np.diff(rows[:, 2]) > s.span)
        edge = np.concatenate([[0], np.nonzero(gap)[0] + 1])
        last = np.append(edge[1:], len(rows)) - 1
        low, high = np.minimum.reduceat(rows[:, 3], edge), np.maximum.reduceat(rows[:, 3], edge)
        return [tuple(map(int, x)) for x in zip(rows[edge, 0], rows[edge, 1], rows[edge, 2], rows[last, 2], low, high, strict=True)]

    def may_leak(self, region: np.ndarray, item: int, low: int, high: int) -> bool:
        """A leak has ``least`` consecutive words of the item inside a stretch that begins at some
        multiple of ``step`` and is ``least + step`` long; its words must be there, and in order."""
        s, words = self.s, self.items[item]
        enough = int(min(s.agree, s.near) * (s.least - s.slack))
        span = s.least + s.step
        mark = self.mark
        mark[region & 0xFFFF] = True
        there = np.concatenate([[0], np.cumsum(mark[self.low_bits[item]])])
        mark[region & 0xFFFF] = False
        starts = np.arange(max(0, low - s.step), high + s.step + 1, s.step)
        starts = starts[starts < len(words)]
        if not len(starts):
            return False
        held = there[np.minimum(starts + span, len(words))] - there[starts]
        for a in starts[held >= enough].tolist():
            part = words[a : a + span]
            if common_words(region, places(part), len(part)) >= enough:
                return True
        return False


def answer_of(text: str | None) -> np.ndarray:
    """The words after an item's last question mark; none where there is no question."""
    head, mark, tail = (text or "").rpartition("?")
    return hashes_of(tail) if mark else np.zeros(0, dtype=np.int64)


def _sum_vectors(rows: DataFrame, key: str, width: int) -> dict[int, np.ndarray]:
    """Vectors added per key with map-side combine; the keys are bounded by the settings."""
    cells = rows.groupBy(key).agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)])
    return {r[0]: np.array(r[1:], dtype=np.float64) for r in cells.collect()}


def _flat(texts: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, starts, _ = _blocks(texts, s.block * s.span)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    return words % s.buckets, starts, owner


def _sketch_into(total: np.ndarray, texts: list[np.ndarray], omega: np.ndarray, idf: np.ndarray, s: Settings) -> None:
    """Adds A'(A omega) of the passages of ``texts``, A their TF-IDF matrix; omega is idf-weighted."""
    words, starts, owner = _flat(texts, s)
    y = block_sums(omega, words, starts)
    order = np.argsort(words, kind="stable")
    edge = np.nonzero(np.diff(words[order], prepend=-1))[0]
    at = words[order][edge]
    total[at] += np.add.reduceat(y[owner[order]], edge, axis=0) * idf[at][:, None]


def fit_space(tokens: DataFrame, items: list[np.ndarray], s: Settings) -> np.ndarray:
    """The latent space: an idf-weighted table of buckets by rank.

    A randomised SVD of the TF-IDF matrix A of all passages of all documents (and of the items):
    term frequencies and A'A times a random matrix are summed over the partitions, an orthonormal
    basis of the sketch is taken, and the Gram matrix of A in it, summed in a second pass, gives the
    leading right singular vectors. Only matrices of buckets x sketch reach the driver.
    """
    spark = tokens.sparkSession
    df = np.zeros(s.buckets)
    terms = F.array_distinct(F.transform("words", lambda w: F.pmod(w, F.lit(s.buckets))))
    for r in tokens.select(F.explode(terms).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r[0]] = r[1]
    n = tokens.count()
    idf = np.log((2.0 + n) / (1.0 + df))
    items = [w for w in items if len(w)]

    def omega() -> np.ndarray:
        return (np.random.default_rng(s.seed).standard_normal((s.buckets, s.sketch)) * idf[:, None]).astype(np.float32)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        om, total = omega(), np.zeros((s.buckets, s.sketch))
        for _, texts in _chunks(batches):
            _sketch_into(total, texts, om, idf, s)
        used = np.nonzero(total.any(axis=1))[0]
        for i in range(0, len(used), 1024):
            yield pd.DataFrame({"k": used[i : i + 1024], "v": list(total[used[i : i + 1024]])})

    total = np.zeros((s.buckets, s.sketch))
    if items:
        _sketch_into(total, items, omega(), idf, s)
    for k, v in _sum_vectors(tokens.select("id", "words").mapInPandas(sketch, "k long, v array<double>"), "k", s.sketch).items():
        total[k] += v
    basis = (np.linalg.qr(total)[0] * idf[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast(basis)

    def gram_of(texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        words, starts, _ = _flat(texts, s)
        y = block_sums(table, words, starts).astype(np.float64)
        return y.T @ y

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((s.sketch, s.sketch))
        for _, texts in _chunks(batches):
            acc += gram_of(texts, shared.value)
        yield pd.DataFrame({"k": np.arange(s.sketch), "v": list(acc)})

    acc = gram_of(items, basis) if items else np.zeros((s.sketch, s.sketch))
    for k, v in _sum_vectors(tokens.select("id", "words").mapInPandas(gram, "k long, v array<double>"), "k", s.sketch).items():
        acc[k] += v
    _, u = np.linalg.eigh(acc)
    return np.ascontiguousarray(basis @ u[:, ::-1][:, : s.rank].astype(np.float32))


LEAK_SCHEMA = "doc_id long, item_id long, n_words int, n_same int, item_from int, answer_leaked boolean"


def find_leaks(docs: DataFrame, items: DataFrame, scratch: Scratch, s: Settings | None = None) -> DataFrame:
    """doc_id, item_id, n_words, n_same, item_from, answer_leaked: every leak, once per pair.

    ``docs``: doc_id, text. ``items``: item_id, text; the evaluation set is collected, since it is
    the query set, and asked in blocks of windows, so its size bounds no broadcast. Passages of every
    document are compared with the items' windows by cosine in the latent space; a candidate's words
    around the near passages are then aligned with the item (local alignment; longest common
    subsequence first, to spare it). The alignment ends before a changed word near its end; one that is
    short by such words is widened over them. A leak holds ``least`` consecutive words of the item of which
    ``agree`` are the same. ``answer_leaked`` tells whether the words after the item's last question
    mark are in the passage.

    Defined cases: null and empty texts hold no leak, rows without a doc_id or item_id are left out,
    repeated rows of a document give repeated rows, and an item of fewer than ``least`` words has
    none. Equal items each get their row. Empty tables give no rows.
    """
    s = s or Settings()
    spark = docs.sparkSession
    asked = [(int(r[0]), r[1]) for r in items.select("item_id", "text").where(F.col("item_id").isNotNull()).orderBy("item_id").collect()]
    known = [(i, hashes_of(t)) for i, t in asked]
    answers = {i: answer_of(t) for i, t in asked}
    tokens, _ = scratch.cut(docs.select(F.col("doc_id").alias("id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(_hash_words, "id long, words array<long>"))
    table = fit_space(tokens, [w for _, w in known], s)

    def search(part: list[tuple[int, np.ndarray]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((table, part, {i: answers[i] for i, _ in part}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table, part, answers = shared.value
            index = Index(table, part, s)
            for ids, texts in _chunks(batches):
                near = []
                for x, item, first, last, low, high in index.search(texts):
                    region = texts[x][max(0, first - 2) * s.block : (last + s.span + 2) * s.block]
                    if index.may_leak(region, item, low, high):
                        near.append((x, item, region))
                hits = leaks_all([r for _, _, r in near], [index.items[i] for _, i, _ in near], [answers[i] for _, i, _ in near], s)
                best: dict[tuple[int, int], tuple] = {}
                for (x, item, region), hit in zip(near, hits, strict=True):
                    if hit and hit[2] - hit[1] > best.get((x, item), (0,))[0]:
                        best[(x, item)] = (hit[2] - hit[1], hit[0], hit[1], has_answer(region, answers[item], s))
                if best:
                    yield pd.DataFrame([(ids[x], i, *v) for (x, i), v in best.items()], columns=["doc_id", "item_id", "n_words", "n_same", "item_from", "answer_leaked"])

        return tokens.mapInPandas(run, LEAK_SCHEMA)

    parts: list[list[tuple[int, np.ndarray]]] = [[]]
    n = 0
    for i, w in known:
        if len(w) < s.least - s.slack:
            continue
        if n > s.query_block:
            parts.append([])
            n = 0
        parts[-1].append((i, w))
        n += len(w) // s.step + 1
    found = search(parts[0])
    for part in parts[1:]:
        found = found.unionByName(search(part))
    return found
