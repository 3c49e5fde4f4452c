"""Operator 9: repeated passages by prefix-free parsing.

The corpus order of all suffixes, as deep as ``LENGTH`` bytes, comes from a
parse into phrases, so that repetitive text is sorted once only:

* Triggers.  A rolling hash of each ``TRIGGER`` bytes; the window of LENGTH
  bytes at each position has its least hash as trigger (leftmost of equals),
  which depends on the window's bytes alone.
* Phrases.  The windows in a row with one trigger form a phrase (at most
  2 x LENGTH bytes).  Documents are sequences of phrases; equal phrases have
  equal fingerprints and equal windows.
* Parse.  For each trigger string, the phrases that carry it meet in one
  bucket.  A phrase that a smaller document has too is repeated as a whole.
* Dictionary.  Where different phrases carry one trigger string, the suffixes
  of the distinct phrases (of each phrase's first document only) are sorted
  and neighbours that agree on LENGTH bytes share their least document.

A batch sends each phrase once, for its first document; later documents of the
batch are known to repeat it.  So a passage of a third of all documents costs
its bucket one entry a batch, not one a document.  Buckets are blobs of sorted
numpy arrays, dealt over ``spark.sql.shuffle.partitions`` tasks.

Null text: as the empty text.  Rows without id have no order: nothing is
removed from them or for them.  Rows of one id are one document.  Texts under
LENGTH bytes are kept whole.  Constant text is one phrase over and over.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.common import P, _powers, mix, sliced, steps, written

LENGTH, TRIGGER = 50, 16
#: Bytes of text that one numpy step parses (and dedupes phrases in) at most.
STEP_BYTES = 2_000_000
ALL = -1  # mask of a phrase that is repeated as a whole
REPEATED, ASKED = 0, 1  # kinds of rows that go to documents
#: Phrases whose suffixes are sorted at once (some 20 windows each).
SORT_PHRASES = 20_000


class Parse:
    """The phrases of some texts: windows ``first`` to ``last`` (positions in
    the joined bytes) with one trigger string ``h`` at ``at``, of document
    ``doc`` (index), fingerprint ``f`` of the phrase."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, k: int = TRIGGER):
        self.limits = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.limits[1:])
        self.b = b = np.frombuffer(b"".join(texts), np.uint8)
        none = np.zeros(0, np.int64)
        self.first = self.last = self.at = self.doc = none
        self.h = self.f = none.astype(np.uint64)
        if len(b) < length:
            return
        up, down = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[b] * up[:-1], out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * down[:len(b) - k + 1]
        width = length - k + 1
        # hash above, place below: a minimum is the least hash, leftmost of equals
        low = (mix(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window at each position
        whole = np.zeros(len(trigger), bool)  # windows inside one text
        change = np.zeros(len(trigger), bool)
        for s, e in zip(self.limits[:-1].tolist(), self.limits[1:].tolist()):
            if e - s >= length:
                whole[s:e - length + 1] = True
                change[s] = True
        change[1:] |= trigger[1:] != trigger[:-1]
        self.first = np.flatnonzero(change & whole)
        stop = np.flatnonzero(whole & ~np.append(whole[1:] & ~change[1:], False))
        self.last, self.at = stop, trigger[self.first]
        self.doc = np.searchsorted(self.limits, self.first, "right") - 1
        self.h = mix(grams[self.at])
        ends = self.last + length
        body = (sums[ends] - sums[self.first]) * down[self.first]
        shape = (self.at - self.first).astype(np.uint64) * np.uint64(256) + (ends - self.first).astype(np.uint64)
        self.f = mix(body + shape * P)


def _planes(x: np.ndarray) -> bytes:
    """64-bit values by byte position: what is alike stands together for the shuffle's compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(x: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _first_of(order_keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (most important last, as in lexsort) and where each
    run of equal values, of all keys but the first, begins in that order."""
    order = np.lexsort(order_keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in order_keys[1:]:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, new


def _parsed(batches, key: int = 0, text: int = 1):
    """(ids, Parse) of each step of each batch; rows without id are left out."""
    for batch in sliced(batches, 2000):
        ids = batch.column(key)
        rows = np.flatnonzero(np.asarray(ids.is_valid()))
        ids, texts = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(text).take(pa.array(rows)).to_pylist()
        texts = [(t or "").encode() for t in texts]
        for a, b in steps(texts, STEP_BYTES):
            yield ids[a:b], Parse(texts[a:b])


def _entries(buckets: int, local: bool):
    """Of each step: the phrases with their first documents, by bucket of the
    trigger string; or, if ``local``, the phrases' later documents."""
    def run(batches):
        for ids, p in _parsed(batches):
            docs = ids[p.doc]
            order, new = _first_of([docs, p.f, p.h])
            h, f, docs = p.h[order], p.f[order], docs[order]
            lead = np.flatnonzero(new)
            first = np.repeat(docs[lead], np.diff(np.append(lead, len(docs))))
            if local:
                later = docs > first
                f, docs = f[later], docs[later]
                yield from _to_docs(docs, f, np.full(len(f), ALL, np.int64), buckets, REPEATED)
                continue
            h, f, docs = h[new], f[new], docs[new]
            yield from _blobs((h % np.uint64(buckets)).astype(np.int64), buckets, {"h": h, "f": f, "doc": docs})
    return run


def _place(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _blobs(bucket: np.ndarray, buckets: int, cols: dict[str, np.ndarray], kind: int | None = None):
    """One row a bucket: its part of the columns as bytes (64-bit ones by planes)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.searchsorted(bucket[order], np.arange(buckets)), len(order)).tolist()
    full = [(i, order[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    arrays = [pa.array([i for i, _ in full], pa.int32())]
    names = ["bucket", *cols]
    for c in cols.values():
        arrays.append(pa.array([_planes(c[o]) if c.ndim == 1 else c[o].tobytes() for _, o in full], pa.binary()))
    if kind is not None:
        arrays.append(pa.array([kind] * len(full), pa.int32()))
        names.append("kind")
    if full:
        yield pa.RecordBatch.from_arrays(arrays, names)


def _to_docs(docs: np.ndarray, f: np.ndarray, mask: np.ndarray, buckets: int, kind: int):
    """What is repeated (or asked) of documents' phrases, by bucket of the document."""
    if len(docs):
        yield from _blobs(_place(docs, buckets), buckets, {"doc": docs, "f": f, "mask": mask}, kind)


def _gather(batches):
    """One row a document of the bucket: all that came for it."""
    got: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for i, (name, kind) in enumerate((("doc", np.int64), ("f", np.uint64), ("mask", np.int64))):
            got[i] += [_unplanes(x, kind) for x in batch.column(name).to_pylist()]
    if not got[0]:
        return
    docs, f, mask = (np.concatenate(x) for x in got)
    del got
    order = np.argsort(docs, kind="stable")
    docs, f, mask = docs[order], f[order], mask[order]
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    cuts = np.append(starts, len(docs)).tolist()
    for i in range(0, len(starts), 5000):
        part = list(zip(cuts[i:i + 5000], cuts[i + 1:i + 5001]))
        yield pa.RecordBatch.from_arrays([
            pa.array(docs[starts[i:i + 5000]]), pa.array([f[a:b].tobytes() for a, b in part], pa.binary()),
            pa.array([mask[a:b].tobytes() for a, b in part], pa.binary())], ["k", "f", "mask"])


def _meet(buckets: int):
    return lambda batches: _met(batches, buckets)


def _met(batches, buckets: int):
    """Of one bucket's entries: phrases that a smaller document has (mask ALL),
    and, of trigger strings with several phrases and documents, each phrase's
    first document, of which the bytes are asked for (mask 0)."""
    got = [[], [], []]
    for batch in batches:
        for i in range(3):
            got[i] += [_unplanes(x) for x in batch.column(i + 1).to_pylist()]
    if not got[0]:
        return
    h, f, docs = (np.concatenate(x) for x in got)
    docs = docs.view(np.int64)
    del got
    order = np.argsort(h, kind="stable")
    h, f, docs = h[order], f[order], docs[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(start, len(h)))
    several = np.repeat(np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start), size)
    h, f, docs = h[several], f[several], docs[several]  # trigger strings of several documents
    if not len(h):
        return
    order, new = _first_of([docs, f, h])
    h, f, docs = h[order], f[order], docs[order]
    lead = np.flatnonzero(new)
    first = np.repeat(docs[lead], np.diff(np.append(lead, len(docs))))
    later = docs > first
    yield from _to_docs(docs[later], f[later], np.full(int(later.sum()), ALL, np.int64), buckets, REPEATED)
    h, f, docs = h[new], f[new], docs[new]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(start, len(h)))
    asked = np.repeat((size > 1) & (np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start)), size)
    yield from _to_docs(docs[asked], f[asked], np.zeros(int(asked.sum()), np.int64), buckets, ASKED)


def _marks(f_blobs, mask_blobs):
    """Sorted keys (row, fingerprint) and masks of the rows' blobs; masks of one key are united."""
    rows, fs, ms = [], [], []
    for i, (x, y) in enumerate(zip(f_blobs, mask_blobs)):
        if x:
            fs.append(np.frombuffer(x, np.uint64))
            ms.append(np.frombuffer(y, np.int64))
            rows.append(np.full(len(fs[-1]), i, np.uint64))
    if not fs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.concatenate(fs) ^ mix(np.concatenate(rows) + np.uint64(1))
    mask = np.concatenate(ms)
    order = np.argsort(key, kind="stable")
    key, mask = key[order], mask[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[start], np.bitwise_or.reduceat(mask, start)


def _found(p: Parse, key: np.ndarray):
    """Phrases of p that have a mark, and the mark's place in ``key``."""
    if not len(key) or not len(p.f):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = p.f ^ mix(p.doc.astype(np.uint64) + np.uint64(1))
    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
    hit = np.flatnonzero(key[at] == own)
    return hit, at[hit]


def _marked(batches):
    """(rows, texts, Parse, keys, masks) of each step of rows with k, text, f
    blobs and mask blobs; texts without a mark are parsed as empty."""
    for batch in sliced(batches, 2000):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        for a, b in steps(texts, STEP_BYTES):
            own = batch.slice(a, b - a)
            f, mask = own.column("f").to_pylist(), own.column("mask").to_pylist()
            yield own, texts[a:b], Parse([t if x else b"" for t, x in zip(texts[a:b], f)]), *_marks(f, mask)


def _ask(buckets: int):
    """The asked phrases' bytes, padded to one length, by bucket of the trigger string."""
    most = 2 * LENGTH

    def run(batches):
        for own, _, p, key, _ in _marked(batches):
            hit, _ = _found(p, key)
            if not len(hit):
                continue
            ids = own.column("k").to_numpy(zero_copy_only=False)
            one = np.unique(np.stack([p.doc[hit].astype(np.uint64), p.f[hit]]), axis=1, return_index=True)[1]
            hit = hit[one]
            h, f, docs = p.h[hit], p.f[hit], ids[p.doc[hit]].astype(np.int64)
            n = p.last[hit] - p.first[hit] + LENGTH
            padded = np.append(p.b, np.zeros(most, np.uint8))
            body = padded[p.first[hit][:, None] + np.arange(most)]
            body[np.arange(most) >= n[:, None]] = 0
            shape = np.stack([p.at[hit] - p.first[hit], n], 1).astype(np.uint8)
            yield from _blobs((h % np.uint64(buckets)).astype(np.int64), buckets, {"h": h, "f": f, "doc": docs, "shape": shape, "body": body})
    return run


def _sorted_suffixes(buckets: int):
    return lambda batches: _suffixes(batches, buckets)


def _suffixes(batches, buckets: int):
    """Of one bucket's dictionary: its phrases' windows in order of their
    bytes; those that a smaller document has, as bits of the phrase's mask."""
    most = 2 * LENGTH
    got: list[list[np.ndarray]] = [[], [], [], [], []]
    for batch in batches:
        for i in range(3):
            got[i] += [_unplanes(x) for x in batch.column(i + 1).to_pylist()]
        got[3] += [np.frombuffer(x, np.uint8).reshape(-1, 2) for x in batch.column(4).to_pylist()]
        got[4] += [np.frombuffer(x, np.uint8).reshape(-1, most) for x in batch.column(5).to_pylist()]
    if not got[0]:
        return
    h, f, docs, shape, body = (np.concatenate(x) for x in got)
    docs = docs.view(np.int64)
    order = np.argsort(h, kind="stable")
    cuts = [0]
    sorted_h = h[order]
    while cuts[-1] < len(h):  # some trigger strings at a time: bounded windows in memory
        to = min(len(h), cuts[-1] + SORT_PHRASES)
        cuts.append(int(np.searchsorted(sorted_h, sorted_h[to - 1], "right")))
    for a, b in zip(cuts, cuts[1:]):
        o = order[a:b]
        n = shape[o, 1].astype(np.int64) - LENGTH + 1
        row = np.repeat(o, n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        words = [np.zeros(len(row), np.uint64) for _ in range(7)]
        flat = body.ravel()
        base = row * most + place
        for w in range(7):  # 50 bytes as 7 big-endian numbers: their order is that of the bytes
            for j in range(8):
                x = flat[base + 8 * w + j].astype(np.uint64) if 8 * w + j < LENGTH else np.uint64(0)
                words[w] = words[w] << np.uint64(8) | x
        owner = docs[row]
        suffixes, new = _first_of([owner, *words[::-1]])
        starts = np.flatnonzero(new)
        least = np.repeat(owner[suffixes][starts], np.diff(np.append(starts, len(suffixes))))
        again = suffixes[owner[suffixes] > least]
        if len(again):
            mask = np.zeros(len(h), np.int64)
            np.bitwise_or.at(mask, row[again], np.int64(1) << place[again])
            hit = np.flatnonzero(mask)
            yield from _to_docs(docs[hit], f[hit], mask[hit], buckets, REPEATED)


def _cover(as_text: bool):
    def run(batches):
        for own, texts, p, key, mask in _marked(batches):
            delta = np.zeros(len(p.b) + 1, np.int32)
            hit, at = _found(p, key)
            for bit in range(LENGTH - TRIGGER + 1):
                w = p.first[hit] + bit
                w = w[(w <= p.last[hit]) & ((mask[at] >> bit) & 1 == 1)]
                np.add.at(delta, w, 1)
                np.add.at(delta, w + LENGTH, -1)
            gone = np.cumsum(delta[:-1]) > 0
            lead = gone.copy()
            lead[1:] &= ~gone[:-1]
            begin = p.limits[:-1][p.limits[:-1] < len(gone)]
            lead[begin] = gone[begin]
            removed, spans, kept = [], [], []
            for t, a, b in zip(texts, p.limits[:-1].tolist(), p.limits[1:].tolist()):
                n = int(np.count_nonzero(gone[a:b]))
                removed.append(n)
                spans.append(int(lead[a:b].sum()) if n else 0)
                kept.append(p.b[a:b][~gone[a:b]].tobytes() if n else t)
            last = pa.array([k.decode(errors="ignore") for k in kept]) if as_text else pa.array([sha256(k).hexdigest() for k in kept])
            carried = [n for n in own.schema.names if n[0] == "c"]
            yield pa.RecordBatch.from_arrays([
                own.column("k"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), last,
                *[own.column(n) for n in carried]], ["k", "n_bytes", "n_removed", "n_spans", "kept", *carried])
    return run


def remove_repeats(df: DataFrame, as_text: bool = True, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and ``kept``: what stays of the text (a
    cut character goes whole), or its bytes' SHA-256; the columns ``carry`` as
    they are.  One row for each row."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carried = [f"c{i}" for i in range(len(carry))]
    docs = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, carried)])
    entry, mark = "bucket int, h binary, f binary, doc binary", "bucket int, doc binary, f binary, mask binary, kind int"
    deal = lambda rows: rows.repartitionById(buckets, F.col("bucket"))
    per_doc = lambda rows: deal(rows).mapInArrow(_gather, "k bigint, f binary, mask binary")
    plain = docs.select("k", "text")
    met = written(deal(plain.mapInArrow(_entries(buckets, False), entry)).mapInArrow(_meet(buckets), mark), "repeats")
    local = plain.mapInArrow(_entries(buckets, True), mark)
    # both joins deal the texts out alike, so Spark shuffles them once (a reused exchange)
    asked = docs.join(per_doc(met.where(F.col("kind") == ASKED)), "k", "left").mapInArrow(_ask(buckets), f"{entry}, shape binary, body binary")
    parts = deal(asked).mapInArrow(_sorted_suffixes(buckets), mark)
    marks = per_doc(met.where(F.col("kind") == REPEATED).unionByName(local).unionByName(parts))
    kinds = dict(docs.dtypes)
    out = docs.join(marks, "k", "left").mapInArrow(_cover(as_text), ", ".join(
        ["k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept string", *[f"{n} {kinds[n]}" for n in carried]]))
    return out.select(F.col("k").alias(key), "n_bytes", "n_removed", "n_spans", "kept", *[F.col(n).alias(c) for c, n in zip(carry, carried)])
