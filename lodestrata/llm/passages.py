"""Near-duplicate passages by compact windows.

A text's tokens are its five-word shingles. For each of several hash functions the Cartesian tree over the tokens' hashes
parts all passages of at least 46 tokens (50 words) into compact windows: all passages inside one that hold its middle have
the middle as their least token, so two passages share a signature exactly if they lie in windows of one key. Windows
travel as packed arrays from chunks of documents to buckets of keys. There each window is first paired with those of the
smallest and of the next smaller document of its key; a key that stands in many documents makes as many pairs, not their
square, and costs each chunk one entry. Pairs return to their chunk, where those of one document pair and nearby places are
joined as intervals; where enough hash functions meet, the passage goes to the chunk that holds the earlier text and is
verified there, token by token.

Keys of three or more documents are crowded. A window of theirs whose middle lies in no passage found so far then goes on
through all smaller documents of its key, whatever their number, until one holds its passage. Only holders whose windows have
enough tokens in common around the middle are compared, by a prefix filter that misses none (`alike`); windows that are word by word in an
earlier one answer through that one.

A passage is reported in the later document if at least 80 % of its shingles, and of those of the earlier text beside it,
agree, over 50 words or more. Null text counts as empty; texts under 50 words have no passages. Rows with equal doc_ids
aren't compared with one another; a null doc_id is later than all others. An empty table gives an empty result. Columns
besides doc_id and text are ignored, and returned as they are where documents are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .chunks import LAST, bucket_count, bucket_of, chunk_table, each_row, marked, opened, slices, small_batches
from .common import reused_memory, stow

SHINGLE, WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, and how many of them must meet.
FUNCTIONS, ENOUGH = 4, 2
#: Steps from a middle at which runs of _RUN tokens begin; such a run in common is enough without a second function.
RUN_STEP = 5
#: Bytes of asked tokens that are verified beside one copy of a chunk.
PART_BYTES = 4 << 20
#: Tokens to either side of its middle that a window reaches at most; longer passages lie in several windows.
REACH = 255
_TOKENS = WORDS - SHINGLE + 1
_RUN = _TOKENS - RUN_STEP
#: Agreeing tokens of either side from which the Jaccard similarity is SIMILARITY.
_SHARE = 2 * SIMILARITY / (1 + SIMILARITY)
#: Agreeing tokens that a passage has at least.
_COMMON = math.ceil(_SHARE * _TOKENS)
_ODD = np.random.default_rng(41).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIDDLE = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 23

#: Tokens to either side of its middle that a window carries to its key's other holders. A passage of twice _TOKENS or more
#: that is similar enough has a similar part of at least _TOKENS, so the parts under that length say whether there is one.
CONTEXT = 2 * _TOKENS - 1
#: Windows of one key that meet in one task; those of a key with more are dealt into blocks, and blocks meet in pairs.
TILE = 4096
#: Numbers that the array code expands at once, and tokens of windows that it compares at once.
_EXPANDED, _AT_ONCE = 1 << 19, 1 << 18

_HEAD = np.dtype([("doc", "<i8"), ("row", "<u4"), ("middle", "<u4"), ("left", "u1"), ("right", "u1"), ("function", "u1"), ("docs", "u1")])
_PLACE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("middle", "<u4"), ("left", "u1"), ("right", "u1")])
_STATE = np.dtype([("at", "<u4"), ("key", "<u8"), ("doc", "<i8"), ("open", "?"), ("copy", "?")])
_WANTED = np.dtype([("at", "<u4"), ("open", "?"), ("blocks", "<u4")])
_HOLDER = np.dtype([*_PLACE.descr, ("open", "?"), ("side", "u1")])
_PAIR = np.dtype([("entry", "<u4"), ("chunk", "<i8"), ("nearest", "?"), *_HEAD.descr])
_ASK = np.dtype([("chunk", "<i8"), ("doc", "<i8"), ("row", "<u4"), ("start", "<u4"), ("size", "<u4"), ("their_row", "<u4"), ("their_start", "<i8"), ("their_end", "<i8")])


def compact_windows(hashes: np.ndarray, at: np.ndarray, least: int, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle, first and last token of each Cartesian-tree node that spans at least `least` tokens, at most `reach` to a side."""
    n = len(hashes)
    counts = np.maximum(np.diff(at) - least + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], counts)
    found = []
    for low in range(0, n, _SEGMENT):  # nodes so wide are the least of some span of `least` tokens
        s = starts[np.searchsorted(starts, low) : np.searchsorted(starts, low + _SEGMENT)]
        if not len(s):
            continue
        part = hashes[low : low + _SEGMENT + least]
        held = part & ~_MIDDLE | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= least:
            held = np.minimum(held[:-width], held[width:])
            width *= 2
        if width < least:
            held = np.minimum(held[: width - least], held[least - width :])
        found.append(np.flatnonzero(_marks((held[s - low] & _MIDDLE).astype(np.int64), len(part))) + low)  # in order, at less than a hash table's cost
    middle = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)
    tables = [hashes]
    while 1 << len(tables) <= reach + 1 and len(tables[-1]) > 1 << len(tables) - 1:
        half = 1 << len(tables) - 1
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    doc = np.searchsorted(at, middle, side="right") - 1
    first_of, last_of, own = np.maximum(at[doc], middle - reach), np.minimum(at[doc + 1] - 1, middle + reach), hashes[middle]
    left, right = middle, middle
    for level in range(len(tables) - 1, -1, -1):
        step, table = 1 << level, tables[level]
        to = left - step
        ok = (to >= first_of) & (table[np.maximum(to, 0)] > own)  # an equal token to the left has precedence
        left = np.where(ok, to, left)
        to = right + step
        ok = (to <= last_of) & (table[np.minimum(right + 1, len(table) - 1)] >= own)
        right = np.where(ok, to, right)
    wide = right - left + 1 >= least
    return middle[wide], left[wide], right[wide]


def _marks(values: np.ndarray, n: int) -> np.ndarray:
    held = np.zeros(n, bool)
    held[values] = True
    return held


def ordered(key: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.lexsort((*ties, key)), and which places of it hold a key that stands there more than once; only those are sorted by ties."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    shared = same[1:] | same[:-1]
    among = np.sort(order[shared])
    order[shared] = among[np.lexsort((*(x[among] for x in ties), key[among]))]
    return order, shared


def packed(rows: np.ndarray) -> bytes:
    """Byte by byte of all rows, as the high bytes of their numbers, mostly zero, compress well together."""
    return rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _unpacked(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    """All parts, one after the other; np.concatenate of rows settles their type anew for each part."""
    out = np.empty((sum(map(len, parts)) // kind.itemsize, kind.itemsize), np.uint8)
    np.concatenate([np.zeros((kind.itemsize, 0), np.uint8), *(np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1) for x in parts)], axis=1, out=out.T)
    return out.view(kind).ravel()


class Chunk:
    """Shingles of a chunk's documents and its windows, one entry for each key (that of the smallest document).

    rows: the documents whose shingles are needed, if not all; the others get none.
    """

    def __init__(self, texts: W.Texts, ids: np.ndarray, rows: np.ndarray | None = None):
        if rows is not None:
            size, needed = np.diff(texts.at), _marks(rows, len(ids))
            texts = W.Texts(texts.data[np.repeat(needed, size)], np.concatenate([[0], np.cumsum(size * needed)]))
        self.texts, self.ids = texts, ids
        self.starts, self.ends, self.word_at = texts.words()
        words = W.span_hashes(texts.prefix_hashes(), self.starts, self.ends)
        self.shingles, self.at = W.grams(words, self.word_at, SHINGLE)

    def windows(self) -> None:
        parts = []
        for f, odd in enumerate(_ODD):
            middle, left, right = compact_windows(W.mix(self.shingles * odd), self.at, _TOKENS)
            parts.append((W.mix(self.shingles[middle] * odd + np.uint64(f)), np.full(len(middle), f, np.uint8), middle, left, right))
        _, _, middle, left, right = parts[0]
        for before in range(0, _RUN, RUN_STEP):
            ok = (middle - before >= left) & (middle - before + _RUN - 1 <= right)
            parts.append((W.run_hashes(self.shingles, middle[ok] - before, _RUN), np.full(int(ok.sum()), FUNCTIONS, np.uint8), middle[ok], left[ok], right[ok]))
        key, self.function, self.middle, self.left, self.right = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.row = np.searchsorted(self.at, self.middle, side="right") - 1
        self.doc = self.ids[self.row] if len(self.ids) else np.zeros(0, np.int64)
        order, _ = ordered(key, self.middle, self.doc)
        k, d = key[order], self.doc[order]
        fresh = np.concatenate([[True], k[1:] != k[:-1]]) if len(key) else np.zeros(0, bool)
        self.key, self.lead = k[fresh], order[fresh]
        self.entry = np.empty(len(key), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        # of each window the last of the same key in the next smaller document, or -1
        begin = fresh | np.concatenate([[True], d[1:] != d[:-1]]) if len(key) else fresh
        first = np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(key) else order
        self.docs = np.minimum(np.add.reduceat(begin.astype(np.int64), np.flatnonzero(fresh)), 255) if len(key) else order
        self.before = np.empty(len(key), np.int64)
        self.before[order] = np.where(fresh[first], -1, order[first - 1]) if len(key) else order


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    with reused_memory():
        yield from each_row(batches)


def _reusing(step: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        with reused_memory():
            return step(table)

    return run


def _entries(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, n, keys, heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            c = Chunk(*opened(r["ids"], r["sizes"], r["body"]))
            c.windows()
            w = c.lead
            heads = np.empty(len(w), _HEAD)
            heads["doc"], heads["row"], heads["middle"], heads["function"] = c.doc[w], c.row[w], c.middle[w] - c.at[c.row[w]], c.function[w]
            heads["left"], heads["right"], heads["docs"] = c.middle[w] - c.left[w], c.right[w] - c.middle[w], c.docs
            out = [(b, r["chunk"], j - i, c.key[i:j].astype("<u4").tobytes(), packed(heads[i:j])) for b, i, j in slices(bucket_of(c.key, buckets))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "n", "keys", "heads"])

    return chunks.mapInArrow(run, "bucket long, chunk long, n long, keys binary, heads binary")


def _table(rows: list[tuple], names: list[str], *kinds: pa.DataType) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _pairs(table: pa.Table) -> pa.Table:
    """For each entry whose key a smaller document has: the window of the smallest, and of the next smaller one but for runs.

    crowded: entries whose key, no run, three documents or more have, so that these two may not be all.
    """
    rows = table.to_pydict()
    key = np.concatenate([np.frombuffer(x, "<u4") for x in rows["keys"]])
    head = _unpacked(rows["heads"], _HEAD)
    ends = np.cumsum([0, *rows["n"]])
    of = np.repeat(np.arange(len(rows["n"])), rows["n"])
    order, shared = ordered(key, np.array(rows["chunk"])[of], head["doc"], head["function"])
    order = order[shared | (head["docs"][order] > 2)]  # others have no partner
    if not len(order):
        return _table([], ["chunk", "bucket", "pairs", "crowded"], pa.int64(), pa.int64(), pa.binary(), pa.binary())
    k, d, f = key[order], head["doc"][order], head["function"][order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])])
    least = np.flatnonzero(new)[np.cumsum(new) - 1]
    begin = new | np.concatenate([[True], d[1:] != d[:-1]])
    nearest = np.flatnonzero(begin)[np.cumsum(begin) - 1] - 1
    later = d > d[least]
    both = []
    for near, at, partner in ((False, np.flatnonzero(later), least), (True, np.flatnonzero(later & (f < FUNCTIONS) & (nearest > least)), nearest)):
        mine, theirs = order[at], order[partner[at]]
        pairs = np.empty(len(at), _PAIR)
        pairs["entry"], pairs["chunk"], pairs["nearest"] = mine - ends[of[mine]], np.array(rows["chunk"])[of[theirs]], near
        for name in _HEAD.names:
            pairs[name] = head[name][theirs]
        both.append((of[mine], pairs))
    mine, pairs = (np.concatenate(x) for x in zip(*both, strict=True))
    by = np.argsort(mine, kind="stable")
    held = {k: packed(pairs[by[i:j]]) for k, i, j in slices(mine[by])}
    docs = np.add.reduceat(head["docs"][order].astype(np.int64), np.flatnonzero(new))
    many = np.sort(order[(docs[np.cumsum(new) - 1] > 2) & (f < FUNCTIONS)])
    crowded = {k: (many[i:j] - ends[k]).astype("<u4").tobytes() for k, i, j in slices(of[many])}
    told = sorted(held.keys() | crowded.keys())
    out = [(rows["chunk"][k], rows["bucket"][k], held.get(k, b""), crowded.get(k, b"")) for k in told]
    return _table(out, ["chunk", "bucket", "pairs", "crowded"], pa.int64(), pa.int64(), pa.binary(), pa.binary())


def intervals(rows: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """Joins window pairs: groups of pairs of one document pair, with nearby middles and offsets, where enough functions meet or a run does.

    Groups whose middles all lie in such runs have nothing to add, and are left out.
    """
    if not len(rows["middle"]):
        return
    offset = rows["middle"].astype(np.int64) - rows["their_middle"]
    order = np.lexsort((rows["middle"], rows["their_row"], rows["chunk"], rows["row"]))
    same = np.ones(len(order), bool)
    for name in ("row", "chunk", "their_row"):
        same[1:] &= rows[name][order[1:]] == rows[name][order[:-1]]
    middle = rows["middle"][order].astype(np.int64)
    same[1:] &= (middle[1:] - middle[:-1] <= REACH) & (np.abs(offset[order[1:]] - offset[order[:-1]]) <= _TOKENS)
    same[:1] = False
    edges = np.flatnonzero(~same)
    for i, j in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist(), strict=True):
        group = order[i:j]
        met = np.bitwise_or.reduce(1 << rows["function"][group].astype(np.int64)).item()
        if met >> FUNCTIONS or met.bit_count() >= ENOUGH and not rows["covered"][group].all():
            yield group


def _asks(coded: DataFrame) -> DataFrame:
    """to, ask, tokens: passages to be verified, grouped by the chunk that holds the earlier text.

    Rows without ask: the windows of a chunk whose keys are crowded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            c = Chunk(*opened(r["ids"], r["sizes"], r["body"]))
            c.windows()
            keyed = bucket_of(c.key, r["buckets"])
            begin = {b: i for b, i, _ in slices(keyed)}
            answers = r["answers"] or []
            first = np.array([begin[x["bucket"]] for x in answers], np.int64)
            pair = _unpacked([x["pairs"] for x in answers], _PAIR)
            entry = pair["entry"] + np.repeat(first, [len(x["pairs"]) // _PAIR.itemsize for x in answers])
            many = np.zeros(len(c.key), bool)
            many[np.frombuffer(b"".join(x["crowded"] for x in answers), "<u4") + np.repeat(first, [len(x["crowded"]) // 4 for x in answers])] = True
            held = np.flatnonzero(many[c.entry])
            places = np.empty(len(held), _PLACE)
            for name, values in (("key", c.key[c.entry]), ("doc", c.doc), ("row", c.row), ("middle", c.middle - c.at[c.row]), ("left", c.middle - c.left), ("right", c.right - c.middle)):
                places[name] = values[held]
            w = np.arange(len(c.entry))
            lead, mine, theirs = c.lead[c.entry], [], []
            # windows in other chunks: those of a key's smallest document, and of the next smaller one
            for near in (False, True):
                to = np.full(len(c.key), -1)
                to[entry[pair["nearest"] == near]] = np.flatnonzero(pair["nearest"] == near)
                far = w[to[c.entry] >= 0]
                mine.append(far)
                theirs.append(pair[to[c.entry[far]]])
                if not near:
                    first_here = to[c.entry] < 0
            # windows in this chunk, likewise
            for own, partner in ((w[first_here & (c.doc > c.doc[lead])], lead), (w[(c.function < FUNCTIONS) & (c.before >= 0)], c.before)):
                p = np.zeros(len(own), _PAIR)
                t = partner[own]
                p["chunk"], p["doc"], p["row"], p["middle"] = r["chunk"], c.doc[t], c.row[t], c.middle[t] - c.at[c.row[t]]
                p["left"], p["right"] = (c.middle - c.left)[t], (c.right - c.middle)[t]
                mine.append(own)
                theirs.append(p)
            w, p = np.concatenate(mine), np.concatenate(theirs)
            known = np.zeros(len(c.shingles), bool)
            runs = w[c.function[w] == FUNCTIONS]
            known[c.middle[runs]] = True
            rows = {
                "row": c.row[w], "middle": c.middle[w] - c.at[c.row[w]], "function": c.function[w], "left": (c.middle - c.left)[w], "right": (c.right - c.middle)[w], "covered": known[c.middle[w]], "chunk": p["chunk"],
                "their_row": p["row"].astype(np.int64), "their_middle": p["middle"].astype(np.int64), "their_left": p["left"].astype(np.int64), "their_right": p["right"].astype(np.int64),
            }
            asks: dict[int, list[tuple]] = {}
            for g in intervals(rows):
                row = int(rows["row"][g[0]])
                n = int(c.at[row + 1] - c.at[row])
                start = max(0, int((rows["middle"][g] - rows["left"][g]).min()) - _TOKENS)
                end = min(n, int((rows["middle"][g] + rows["right"][g]).max()) + 1 + _TOKENS)
                theirs = int((rows["their_middle"][g] - rows["their_left"][g]).min()) - _TOKENS, int((rows["their_middle"][g] + rows["their_right"][g]).max()) + 1 + _TOKENS
                asks.setdefault(int(rows["chunk"][g[0]]), []).append((r["chunk"], int(c.ids[row]), row, start, end - start, int(rows["their_row"][g[0]]), *theirs))
            out = [(r["chunk"], None, None, packed(places))] if len(places) else []
            for chunk, list_ in asks.items():
                ask = np.array(list_, _ASK)
                out.append((chunk, ask.tobytes(), b"".join(c.shingles[c.at[a[2]] + a[3] : c.at[a[2]] + a[3] + a[4]].astype("<u4").tobytes() for a in list_), None))
            yield from _table(out, ["to", "ask", "tokens", "places"], pa.int64(), pa.binary(), pa.binary(), pa.binary()).to_batches()

    return coded.mapInArrow(run, "to long, ask binary, tokens binary, places binary")


def agreeing(tokens: np.ndarray, earlier: np.ndarray) -> list[tuple[int, int, float]]:
    """(first token, end, similarity) of the passages of `tokens` that `earlier` holds nearly the same."""
    order = np.argsort(earlier, kind="stable")
    held = earlier[order]
    slot = np.searchsorted(held, tokens)
    slot[slot == len(held)] = 0
    hit = (held[slot] == tokens) if len(held) else np.zeros(len(tokens), bool)
    where = order[slot] if len(held) else slot
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    runs = list(zip(at[edge].tolist(), (at[np.append(edge[1:], len(at)) - 1] + 1).tolist(), strict=True))
    joined: list[tuple[int, int, int]] = []
    for i, j in runs:
        joined.append((i, j, j - i))
        # with the run before, as long as enough of both and of what lies between agrees on either side
        while len(joined) > 1 and joined[-2][2] + joined[-1][2] >= _SHARE * (joined[-1][1] - joined[-2][0]):
            (first, _, n), (_, end, more) = joined[-2:]
            joined[-2:] = [(first, end, n + more)]

    def similarity(i: int, j: int, n: int) -> float:
        places = where[i:j][hit[i:j]]
        shift = places - np.arange(i, j)[hit[i:j]]
        close = places[np.abs(shift - np.sort(shift)[len(shift) // 2]) <= _TOKENS + 0.2 * (j - i)]
        return n / ((j - i) + max(0, int(close.max() - close.min()) + 1 - n))

    out = []
    for i, j, n in joined:
        if n >= _RUN and j - i < _TOKENS <= min(len(tokens), len(earlier)):  # with a few tokens more it is long and similar enough
            i = max(0, min(i, len(tokens) - _TOKENS))
            out.append((i, i + _TOKENS, n / (2 * _TOKENS - n)))
        elif j - i >= _TOKENS:
            if (whole := similarity(i, j, n)) >= SIMILARITY:
                out.append((i, j, whole))
            else:
                out += [(a, b, 1.0) for a, b in runs if i <= a and b <= j and b - a >= _TOKENS]
    return out


def _verified(table: pa.Table) -> pa.Table:
    """chunk, row, doc_id, start, n_words, source_id, similarity: passages of later documents, from one part of the asks for a chunk."""
    (r,) = table.to_pylist()
    asks = [np.frombuffer(x["ask"], _ASK) for x in r["asks"]]
    c = Chunk(*opened(r["ids"], r["sizes"], r["body"]), np.concatenate([ask["their_row"] for ask in asks]))
    low, out = c.shingles.astype(np.uint32), []
    for ask, x in zip(asks, r["asks"], strict=True):
        tokens = np.frombuffer(x["tokens"], "<u4")
        ends = np.cumsum(ask["size"])
        for a, end in zip(ask, ends.tolist(), strict=True):
            first, last = int(c.at[a["their_row"]]), int(c.at[a["their_row"] + 1])
            earlier = low[first + max(0, int(a["their_start"])) : min(last, first + int(a["their_end"]))]
            for i, j, similarity in agreeing(tokens[end - int(a["size"]) : end], earlier):
                doc, source = int(a["doc"]), r["ids"][int(a["their_row"])]
                out.append((int(a["chunk"]), int(a["row"]), None if doc == LAST else doc, int(a["start"]) + i, j - i + SHINGLE - 1, source, similarity))
    return _table(out, _FOUND, *_FOUND_KINDS)


_FOUND = ["chunk", "row", "doc_id", "start", "n_words", "source_id", "similarity"]
_FOUND_KINDS = (*[pa.int64()] * 6, pa.float64())
_FOUND_SCHEMA = "chunk long, row long, doc_id long, start long, n_words long, source_id long, similarity double"


def _states(crowded: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, states: crowded windows; open where no passage found so far holds the middle, a copy where one holds the whole context word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            places = unpacked(r["places"], _PLACE)
            row, middle = places["row"].astype(np.int64), places["middle"].astype(np.int64)
            order = np.lexsort((middle, row))
            place = (row << 32) + middle
            ranked = place[order]
            low, high = middle - np.minimum(places["left"], CONTEXT), middle + np.minimum(places["right"], CONTEXT)
            is_open, copy = np.ones(len(places), bool), np.zeros(len(places), bool)
            for x in r["spans"] or []:
                first, last = x["start"], x["start"] + x["n_words"] - SHINGLE
                inside = order[np.searchsorted(ranked, (x["row"] << 32) + first) : np.searchsorted(ranked, (x["row"] << 32) + last, side="right")]
                is_open[inside] = False
                if x["similarity"] == 1:
                    copy[inside] |= (low[inside] >= first) & (high[inside] <= last)
            states = np.empty(len(places), _STATE)
            states["at"], states["key"], states["doc"], states["open"], states["copy"] = np.arange(len(places)), places["key"], places["doc"], is_open, copy
            bucket = bucket_of(places["key"], buckets)
            order = np.argsort(bucket, kind="stable")
            out = [(b, r["chunk"], packed(states[order[i:j]])) for b, i, j in slices(bucket[order])]
            yield from _table(out, ["bucket", "chunk", "states"], pa.int64(), pa.int64(), pa.binary()).to_batches()

    return crowded.mapInArrow(run, "bucket long, chunk long, states binary")


def _wanted(table: pa.Table, tile: int) -> pa.Table:
    """chunk, wanted: open windows that a smaller document's may answer, and those that may answer them; copies of an earlier text can't add to it."""
    rows = table.to_pydict()
    state = _unpacked(rows["states"], _STATE)
    of = np.repeat(np.arange(len(rows["states"])), [len(x) // _STATE.itemsize for x in rows["states"]])
    _, group = np.unique(state["key"], return_inverse=True)
    answers = ~state["copy"]
    least, most = np.full(group.max() + 1, LAST), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, group[answers], state["doc"][answers])
    asking = state["open"] & (state["doc"] > least[group])
    np.maximum.at(most, group[asking], state["doc"][asking])
    use = asking | answers & (state["doc"] < most[group])
    wanted = np.empty(len(state), _WANTED)
    wanted["at"], wanted["open"], wanted["blocks"] = state["at"], asking, (1 + np.bincount(group, use) // tile)[group]
    chosen = np.flatnonzero(use)
    out = [(rows["chunk"][k], packed(wanted[chosen[i:j]])) for k, i, j in slices(of[chosen])]
    return _table(out, ["chunk", "wanted"], pa.int64(), pa.binary())


def _expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _holders(coded: DataFrame, buckets: int) -> DataFrame:
    """cell, chunk, holders, tokens: wanted windows with the tokens around their middles; a cell is a bucket, or two blocks of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            wanted = _unpacked(r["wanted"], _WANTED)
            places = unpacked(r["places"], _PLACE)[wanted["at"]]
            c = Chunk(*opened(r["ids"], r["sizes"], r["body"]), places["row"])
            blocks = wanted["blocks"].astype(np.int64)
            own = (W.mix(places["doc"].astype(np.uint64) * np.uint64(CONTEXT) + places["middle"]) % blocks.astype(np.uint64)).astype(np.int64)
            at, other = np.repeat(np.arange(len(places)), blocks), _expanded(np.zeros(len(places), np.int64), blocks)
            low, high = np.minimum(own[at], other), np.maximum(own[at], other)
            pair = W.mix(places["key"][at] + W.mix((low << 32 | high).astype(np.uint64))) >> np.uint64(1)
            cell = np.where(blocks[at] == 1, bucket_of(places["key"], buckets)[at], -1 - pair.astype(np.int64))
            holders = np.empty(len(at), _HOLDER)
            for name in _PLACE.names:
                holders[name] = places[name][at]
            holders["left"], holders["right"] = np.minimum(holders["left"], CONTEXT), np.minimum(holders["right"], CONTEXT)
            holders["open"], holders["side"] = wanted["open"][at], np.where(low == high, 0, np.where(own[at] == low, 1, 2))
            first = c.at[holders["row"]] + holders["middle"] - holders["left"]
            size = holders["left"].astype(np.int64) + holders["right"] + 1
            order = np.argsort(cell, kind="stable")
            out = []
            for k, i, j in slices(cell[order]):
                w = order[i:j]
                out.append((k, r["chunk"], packed(holders[w]), c.shingles[_expanded(first[w], size[w])].astype("<u4").tobytes()))
            yield from _table(out, ["cell", "chunk", "holders", "tokens"], pa.int64(), pa.int64(), pa.binary(), pa.binary()).to_batches()

    return coded.mapInArrow(run, "cell long, chunk long, holders binary, tokens binary")


def alike(group: np.ndarray, doc: np.ndarray, side: np.ndarray, middle: np.ndarray, asks: np.ndarray, answers: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an asking and an answering window of one group, the latter of a smaller document, that may have a passage around the former's middle.

    That needs _TOKENS or more of the former's tokens, the middle among them, of which a share of _SHARE is in the latter. So
    many aren't all among its _COMMON - 1 most frequent tokens, and pairs come from the others. Windows on one side of two
    blocks aren't paired; 0 is no side. A window's pairs come one after the other, by document, however many arrays they fill.
    """
    n = len(doc)
    by_doc = np.argsort(doc, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_doc] = np.arange(n)
    of = np.repeat(np.arange(n), np.diff(at))
    code, count = np.unique((of.astype(np.uint64) << np.uint64(32)) | tokens, return_counts=True)
    of, token = (code >> np.uint64(32)).astype(np.int64), code & np.uint64((1 << 32) - 1)
    grouped = group[of].astype(np.uint64) << np.uint64(32) | token
    place = np.argsort(grouped, kind="stable")
    new = np.concatenate([[True], grouped[place][1:] != grouped[place][:-1]])
    list_of = np.empty(len(code), np.int64)
    list_of[place] = np.cumsum(new) - 1
    place = place[answers[of[place]]]
    edges = np.searchsorted(list_of[place], np.arange(int(new.sum()) + 1))
    holders = np.diff(edges)
    # a window's tokens from the most frequent one; those past the first _COMMON - 1 seek
    order = np.flatnonzero(asks[of] & (holders[list_of] > 0))
    order = order[np.argsort((of[order] << 32) - holders[list_of[order]], kind="stable")]
    ends = np.cumsum(count[order])
    before = np.concatenate([[0], ends])[np.searchsorted(of[order], of[order])]
    seek = order[ends - before >= _COMMON]
    total = np.cumsum(holders[list_of[seek]])
    low = 0
    while low < len(seek):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + _EXPANDED, side="right")))
        # all of a window's tokens together, so that a pair comes once
        while high < len(seek) and of[seek[high]] == of[seek[high - 1]]:
            high += 1
        part = seek[low:high]
        low = high
        size = holders[list_of[part]]
        mine, theirs = np.repeat(of[part], size), of[place[_expanded(edges[list_of[part]], size)]]
        ok = (doc[theirs] < doc[mine]) & ((side[mine] != side[theirs]) | (side[mine] == 0))
        pair = np.unique(mine[ok] * n + rank[theirs[ok]])
        step = max(1, _EXPANDED // (2 * CONTEXT + 1))
        for i in range(0, len(pair), step):
            mine, theirs = pair[i : i + step] // n, by_doc[pair[i : i + step] % n]
            width = at[mine + 1] - at[mine]
            column = _expanded(np.zeros(len(mine), np.int64), width)
            sought = (np.repeat(theirs, width).astype(np.uint64) << np.uint64(32)) | tokens[_expanded(at[mine], width)]
            hit = np.zeros((len(mine), 2 * CONTEXT + 2), np.float32)
            hit[np.repeat(np.arange(len(mine)), width), column + 1] = code[np.minimum(np.searchsorted(code, sought), len(code) - 1)] == sought
            ok = _dense(hit, middle[mine])
            yield mine[ok], theirs[ok]


def _dense(hit: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1, from column 1 on, that have a stretch of _TOKENS or more around their middle with a share of _SHARE of 1."""
    over = np.cumsum(hit, axis=1) - np.float32(_SHARE) * np.arange(hit.shape[1], dtype=np.float32)
    place = np.arange(hit.shape[1])
    most = np.maximum.accumulate(np.where(place > middle[:, None], over, -np.inf)[:, ::-1], axis=1)[:, ::-1]  # at or after an end past the middle
    begin = np.where(place <= middle[:, None], over, np.inf)
    return (most[:, _TOKENS:] - begin[:, :-_TOKENS] > -1e-3).any(axis=1)


def _met(table: pa.Table) -> pa.Table:
    """chunk, row, doc_id, start, n_words, source_id, similarity: passages of open windows; each goes through its key's smaller documents until one holds its middle's passage."""
    rows = table.to_pydict()
    w = _unpacked(rows["holders"], _HOLDER)
    of = np.repeat(np.arange(len(rows["holders"])), [len(x) // _HOLDER.itemsize for x in rows["holders"]])
    chunk = np.array(rows["chunk"], np.int64)[of]
    tokens = np.concatenate([np.frombuffer(x, "<u4") for x in rows["tokens"]])
    size = w["left"].astype(np.int64) + w["right"] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(w["key"], kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], w["key"][order][1:] != w["key"][order][:-1], [True]]))
    total = np.concatenate([[0], np.cumsum(size[order])])[edges]
    out, low = [], 0
    while low < len(edges) - 1:  # so many keys at once as have _AT_ONCE tokens, or one
        high = max(low + 1, int(np.searchsorted(total, total[low] + _AT_ONCE, side="right")) - 1)
        part = order[edges[low] : edges[high]]
        low = high
        out += _matches(w[part], chunk[part], tokens[_expanded(at[part], size[part])], np.concatenate([[0], np.cumsum(size[part])]))
    return _table(list(dict.fromkeys(out)), _FOUND, *_FOUND_KINDS)


def _matches(w: np.ndarray, chunk: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    group = np.cumsum(np.concatenate([[False], w["key"][1:] != w["key"][:-1]]))
    # of equal contexts the smallest document's answers
    same = W.mix(W.spans(tokens.astype(np.uint64), at) + w["left"])
    order = np.lexsort((w["doc"], w["side"], same, group))
    answers = np.zeros(len(w), bool)
    answers[order] = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (group, same, w["side"])], axis=0)])
    done = -1
    for mine, theirs in alike(group, w["doc"], w["side"], w["left"].astype(np.int64), w["open"], answers, tokens, at):
        for a, b in zip(mine.tolist(), theirs.tolist(), strict=True):
            if a == done:
                continue
            doc, row, middle, left = (int(w[name][a]) for name in ("doc", "row", "middle", "left"))
            for i, j, similarity in agreeing(tokens[at[a] : at[a + 1]], tokens[at[b] : at[b + 1]]):
                if i <= left < j:
                    done = a
                    yield int(chunk[a]), row, None if doc == LAST else doc, middle - left + i, j - i + SHINGLE - 1, int(w["doc"][b]), similarity


def _passages(chunks: DataFrame, tile: int = TILE) -> DataFrame:
    buckets = bucket_count(chunks)
    pairs = _entries(chunks, buckets).groupBy("bucket").applyInArrow(_reusing(_pairs), "chunk long, bucket long, pairs binary, crowded binary")
    answers = pairs.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "pairs", "crowded")).alias("answers"))
    with small_batches(chunks.sparkSession):
        told = stow(_asks(chunks.join(answers, "chunk", "left").withColumn("buckets", F.lit(buckets))))
    found = stow(_answered(chunks, told.where("ask is not null").drop("places")))
    # windows of crowded keys that lie in no passage yet meet all earlier holders
    crowded = told.where("places is not null").select(F.col("to").alias("chunk"), "places")
    spans = found.groupBy("chunk").agg(F.collect_list(F.struct("row", "start", "n_words", "similarity")).alias("spans"))
    states = _states(crowded.join(spans, "chunk", "left"), buckets)
    wanted = states.groupBy("bucket").applyInArrow(_reusing(lambda table: _wanted(table, tile)), "chunk long, wanted binary").groupBy("chunk").agg(F.collect_list("wanted").alias("wanted"))
    with small_batches(chunks.sparkSession):
        more = stow(_holders(chunks.join(crowded.join(wanted, "chunk"), "chunk"), buckets).groupBy("cell").applyInArrow(_reusing(_met), _FOUND_SCHEMA))
    return found.union(more)


def _answered(chunks: DataFrame, asks: DataFrame) -> DataFrame:
    # a chunk whose texts very many ask for is dealt out in several copies
    parts = asks.groupBy("to").agg(F.expr(f"1 + sum(octet_length(tokens)) div {PART_BYTES}").alias("parts"))
    dealt = asks.join(parts, "to").withColumn("part", F.pmod(F.xxhash64("ask"), F.col("parts")))
    by_part = dealt.groupBy(F.col("to").alias("chunk"), "part").agg(F.collect_list(F.struct("ask", "tokens")).alias("asks"))
    copies = chunks.join(parts.withColumnRenamed("to", "chunk"), "chunk").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    return copies.join(by_part, ["chunk", "part"]).groupBy("chunk", "part").applyInArrow(_reusing(_verified), _FOUND_SCHEMA)


def repeated_passages(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Per passage of a document that an earlier one holds: doc_id, start (word, from 0), n_words, source_id, similarity.

    tile: windows of one key that meet in one task; results don't depend on it.
    """
    return _passages(chunk_table(docs).drop("rest"), tile).select("doc_id", "start", "n_words", "source_id", "similarity")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with their texts cut by the passages that an earlier document holds; n_chars follows, and documents left without words go.

    Texts without such a passage, null ones among them, and their n_chars stay as they are.
    """
    names = docs.columns
    others = [c for c in names if c != "text"]
    chunks = chunk_table(docs, others)
    spans = _passages(chunks.drop("rest")).groupBy("chunk").agg(F.collect_list(F.struct("row", "start", "n_words")).alias("spans"))

    def cut(table: pa.Table) -> pa.Table:
        (r,) = table.to_pylist()
        texts, _ = opened(r["ids"], r["sizes"], r["body"])
        starts, ends, at = texts.words()
        spans = r["spans"] or []
        first = np.array([at[s["row"]] + s["start"] for s in spans], np.int64)
        last = first + np.array([s["n_words"] - 1 for s in spans], np.int64)
        gone = marked(len(texts.data), starts[first], ends[last])
        changed = W.sums(gone, texts.at) > 0
        rest = pa.ipc.open_stream(r["rest"]).read_next_batch()
        held = dict(zip(others, rest.columns[:-1], strict=True))
        out = pa.array([texts.data[i:j][~gone[i:j]].tobytes().decode("utf-8", "replace") for i, j in zip(texts.at[:-1].tolist(), texts.at[1:].tolist(), strict=True)], pa.string())
        held["text"] = pa.compute.if_else(rest.columns[-1], pa.scalar(None, pa.string()), out)
        if "n_chars" in held:
            held["n_chars"] = pa.compute.if_else(pa.array(changed), pa.compute.utf8_length(out).cast(held["n_chars"].type), held["n_chars"])
        left = pa.array(~changed | (W.sums(~gone & ~W.SPACES[texts.data], texts.at) > 0))
        return pa.table([held[c] for c in names], names).filter(left)

    return chunks.join(spans, "chunk", "left").groupBy("chunk").applyInArrow(_reusing(cut), docs.schema)
