"""Operator 6: personal data by a semi-Markov conditional random field.

Base patterns give ``email``, ``ip``, ``card`` and ``phone`` spans.  A
semi-Markov CRF adds what the patterns miss (a phone number without its plus,
an address written with ``[at]``, ...): stretches of tokens around digits and
at-signs are segmented jointly, each segment scored by features of the whole
span (shape, digits, checksum, ranges, context), boundaries and kinds chosen
by dynamic programming over segments of ``MAX_TOKENS`` tokens at most.

The weights are learned by conditional likelihood on ``TRAIN_REGIONS``
stretches at most, of the documents with the least hashes of their ids; their
base spans are the labels, each also rewritten in ways the patterns miss, and
spoiled in ways that make it no personal data.  Without any base span in the
sample nothing is added.

Null text: as the empty text.  Long texts: the patterns take linear time, and
so does a stretch, which is segmented as a whole: its lattice is made for
``REGION_TOKENS`` first tokens at a time and the state is carried on.  Repeated rows give repeated
results, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.common import map_texts

#: The base patterns, in the order of the kinds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|\n|.", re.S)
ANCHOR = re.compile(r"[0-9@]|\[at\]|\(at\)", re.I)
SPACE = re.compile(r"\s")
#: Characters around an anchor that belong to its stretch at least.
REACH = 40
MAX_TOKENS, REGION_TOKENS, AROUND = 15, 360, 4
TRAIN_REGIONS, BITS, ROUNDS, MARGIN = 240, 14, 4, 3.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns' matches, by kind and place."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        run = text[low:at]
        local = len(run) - len(run.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((0, at - local, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    if any(d in text for d in "0123456789"):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = only_digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return out


def regions(text: str) -> list[tuple[int, list[str]]]:
    """Disjoint stretches of tokens around digits and at-signs, with the place
    of each: REACH characters to either side and on to the next white space,
    so that no token is cut; stretches that meet are one."""
    out: list[list[int]] = []
    low = 0  # where the last stretch ends
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if not out or a > low:
            a = max(text.rfind(c, low, a) for c in " \n\t") + 1 or low
        if b > low:
            end = SPACE.search(text, b)
            b = end.start() if end else len(text)
        if out and a <= low:
            out[-1][1] = low = max(low, b)
        else:
            out.append([a, b])
            low = b
    return [(a, TOKEN.findall(text, a, b)) for a, b in out]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << BITS) - 1)


def _mixed(template: int, *parts: np.ndarray) -> np.ndarray:
    """Hashed features of one template from whole numbers."""
    h = np.uint64(template)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Tokens:
    """What the features need of each token, as columns.  Digits are 0-9; a
    token is a word, digits, white space or one other character."""

    def __init__(self, tokens: list[str]):
        self.n = len(tokens)
        flag = lambda f: np.fromiter(map(f, tokens), bool, self.n)
        self.digit, self.letter, self.alnum = flag(lambda t: "0" <= t[0] <= "9"), flag(lambda t: t[0].isalpha()), flag(lambda t: t[0].isalnum())
        self.space, self.line = flag(str.isspace), flag("\n".__eq__)
        word_at, opens, self.sign = flag(lambda t: t.lower() == "at"), flag(lambda t: t in "[("), flag("@".__eq__)
        self.hint = self.digit | self.sign | word_at
        self.marked_at = word_at & np.r_[False, opens[:-1]]  # a word "at" behind a bracket
        self.head = self.alnum | flag(lambda t: t[0] in "+(")
        self.bound_left, self.bound_right = self.alnum | flag(lambda t: t in ".@-_"), self.alnum | flag(lambda t: t in "@_")
        self.over = flag(lambda t: "0" <= t[0] <= "9" and (len(t) > 3 or int(t) > 255))
        self.size = np.fromiter(map(len, tokens), np.int64, self.n)
        self.code = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) + 1 for t in tokens), np.int64, self.n)
        self.kind = np.where(self.digit, 1, np.where(self.letter, 2, np.where(self.space, 3, self.code)))
        last: dict[str, int] = {}
        self.earlier = np.full(self.n, -1)  # where the same token was last
        for k, t in enumerate(tokens):
            self.earlier[k] = last.get(t, -1)
            last[t] = k
        # digits before each token, and the sums of Luhn's rule with every second digit doubled from the first or the second on
        self.digits = np.r_[0, np.cumsum(np.where(self.digit, self.size, 0))]
        d = np.frombuffer("".join(t for t in tokens if "0" <= t[0] <= "9").encode(), np.uint8).astype(np.int64) - 48
        twice, even = np.where(d > 4, 2 * d - 9, 2 * d), np.arange(len(d)) % 2 == 0
        self.luhn = np.stack([np.r_[0, np.cumsum(np.where(even == first, twice, d))][self.digits] for first in (True, False)])


def segments(t: Tokens, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and features of all segments that begin at the tokens from
    ``first`` to ``last``, by start and length.  A column holds the segments of
    one length; each is the column before with a token more."""
    i = np.arange(first, last)
    grid = np.zeros((12, len(i), MAX_TOKENS), np.int64)
    parts, letters, joined, shape, exact, groups, at, over, hint, line, valid, ends = grid
    now = np.zeros((10, len(i)), np.int64)
    for m in range(MAX_TOKENS):
        k = np.minimum(i + m, t.n - 1)
        digit, other = t.digit[k], ~t.alnum[k] & (t.earlier[k] < i)
        now[5] = np.where(digit & (now[0] < 6), now[5] * 7 + 1 + np.minimum(t.size[k], 5), now[5])
        now[0] += digit
        now[1] |= t.letter[k]
        now[2] += np.where(other, t.code[k] * t.code[k], 0)
        now[3] = now[3] * 1_000_003 + t.kind[k]
        now[4] = (now[4] * 1_000_003 + t.kind[k]) * 31 + np.where(t.digit[k] | t.letter[k], t.size[k], 0)
        now[6] |= t.sign[k] | (t.marked_at[k] & (m > 0))
        now[7] |= t.over[k]
        now[8] |= t.hint[k]
        now[9] |= t.line[k] & (m > 0)
        grid[:10, :, m] = now
        ends[:, m] = i + m + 1
        valid[:, m] = (i + m < t.n) & (now[9] == 0)
        if m:
            valid[:, m] &= ~t.space[i] & ~t.space[k] & (now[8] > 0)
    keep = valid.astype(bool)
    starts, ends = np.broadcast_to(i[:, None], keep.shape)[keep], ends[keep]
    parts, letters, joined, shape, exact, groups, at, over = (x[keep] for x in grid[:8])
    n = t.digits[ends] - t.digits[starts]
    total = np.where(t.digits[ends] % 2 == 0, t.luhn[0][ends] - t.luhn[0][starts], t.luhn[1][ends] - t.luhn[1][starts])
    edge = t.head[starts] * 2 + t.alnum[ends - 1]
    left, right = np.r_[False, t.alnum][starts], np.r_[t.alnum, False][ends]
    loose = np.r_[False, t.bound_left][starts] | np.r_[t.bound_right, False][ends]
    sizes, which = np.unique(n * 2 + letters, return_inverse=True)
    named = np.array([_hash(f"n:{x // 2}:{x % 2 == 1}") for x in sizes.tolist()], np.int64)[which]
    found = [np.full(len(starts), _hash("bias")), _mixed(1, shape), _mixed(2, exact), named, _mixed(3, parts, joined, letters),
             _mixed(4, (n >= 16) & (total % 10 == 0), letters), _mixed(5, (parts == 4) & (over == 0), joined, letters), _mixed(6, at, letters, edge),
             _mixed(7, edge), _mixed(8, loose), _mixed(9, left, edge), _mixed(10, right, edge), _mixed(11, ends - starts, letters), _mixed(12, groups, letters)]
    return starts, ends, np.stack(found, 1)


@dataclass
class Lattice:
    """All segments of a region: ends and starts, features, allowed kinds."""

    n: int
    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray


def lattice(tokens: list[str] | Tokens, first: int = 0, last: int | None = None) -> Lattice:
    """Segments of one token (kind 0, nothing, or an entity) and of more tokens
    that begin and end on a sign of an entity and hold a digit or an at; those
    that begin at the tokens from ``first`` to ``last``, if given."""
    t = tokens if isinstance(tokens, Tokens) else Tokens(tokens)
    return Lattice(t.n, *segments(t, first, t.n if last is None else min(last, t.n)))


def scores(g: Lattice, w: np.ndarray) -> np.ndarray:
    """Score of each segment with each kind (0: no entity, single tokens only)."""
    s = w[:, g.features].sum(-1)
    s[0, g.ends - g.starts > 1] = -np.inf
    return s


def best(tokens: list[str], w: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The best segmentation's entities: kind, first and last token, and how
    much better it is than the same tokens as nothing."""
    n, columns = len(tokens), Tokens(tokens)
    top, none = [0.0] + [-np.inf] * n, np.zeros(n + 1)
    back = [(0, 0, 0.0)] * (n + 1)
    for first in range(0, n, REGION_TOKENS):  # all that ends at a token begins before it: top is final where a block begins
        g = lattice(columns, first, first + REGION_TOKENS)
        s = scores(g, w)
        kind, value = s.argmax(0).tolist(), s.max(0).tolist()
        alone = g.ends - g.starts == 1
        none[g.ends[alone]] = s[0, alone]
        for k, (i, j) in enumerate(zip(g.starts.tolist(), g.ends.tolist())):
            if top[i] + value[k] > top[j]:
                top[j], back[j] = top[i] + value[k], (i, kind[k], value[k])
    sums, out, j = np.cumsum(none), [], n
    while j:
        i, c, value_ = back[j]
        if c:
            out.append((c - 1, i, j, float(value_ - (sums[j] - sums[i]))))
        j = i
    return out[::-1]


def gradient(g: Lattice, w: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Expected minus observed segments, by kind and segment (forward and backward sums)."""
    s = scores(g, w)
    total = np.logaddexp.reduce(s, 0)
    order = np.argsort(g.starts, kind="stable")
    a = np.full(g.n + 1, -np.inf)
    b = np.full(g.n + 1, -np.inf)
    a[0], b[g.n] = 0, 0
    for k in order.tolist():
        a[g.ends[k]] = np.logaddexp(a[g.ends[k]], a[g.starts[k]] + total[k])
    for k in order[::-1].tolist():
        b[g.starts[k]] = np.logaddexp(b[g.starts[k]], b[g.ends[k]] + total[k])
    p = np.exp(np.clip(a[g.starts] + b[g.ends] - a[g.n] + s, -50, 0))
    for k in range(len(g.starts)):
        c = gold.get((int(g.starts[k]), int(g.ends[k])))
        if c is not None:
            p[c, k] -= 1
    return p


def _variants(text: str, kind: int, rng: random.Random) -> list[tuple[str, int]]:
    """A base span as it is, rewritten (same kind), and spoiled (kind 0: nothing)."""
    digits = only_digits(text)
    other = lambda s: "".join(c if not c.isdigit() else str(rng.randrange(10)) for c in s)
    if kind == 0:
        local, _, domain = text.partition("@")
        return [(text, 1), (f"{local}[at]{domain}", 1), (f"{local} [at] {domain}", 1), (f"{local}(at){domain}", 1), (domain, 0), (f"{local.split('.')[0]} at {domain}", 0)]
    if kind == 1:
        return [(text, 2), (".".join(str(rng.randrange(256)) for _ in range(4)), 2), (f"{rng.randrange(256, 999)}.{text.partition('.')[2]}", 0),
                (text.rsplit(".", 1)[0], 0), (f"{rng.randrange(9)}.{rng.randrange(99)}", 0)]
    if kind == 2:
        bad = digits[:-1] + str((int(digits[-1]) + 1 + rng.randrange(8)) % 10)
        return [(text, 3), (".".join(digits[i:i + 4] for i in range(0, len(digits), 4)), 3), (bad, 0), (digits[:rng.randrange(4, 12)], 0), (f"20{digits[:2]}-{digits[2:4]}-{digits[4:6]}", 0)]
    tail = other(digits[-10:])
    return [(text, 4), (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", 4), (f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", 4), (f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", 4), (tail[:5], 0), (f"{tail[:3]}-{tail[3:5]}", 0)]


def train(samples: list[tuple[str, str, str, int]], seed: int = 7) -> np.ndarray | None:
    """Weights by kind and feature from (left context, span, right context, kind)."""
    if not samples:
        return None
    rng = random.Random(seed)
    data = []
    for left, span, right, kind in samples:
        choice = _variants(span, kind, rng)
        for text, c in {choice[0], choice[rng.randrange(1, len(choice))], choice[-1 - rng.randrange(2)]}:
            l, m, r = (TOKEN.findall(x) for x in (left, text, right))
            l, r = l[-AROUND:], r[:AROUND]
            if len(m) > MAX_TOKENS:
                continue
            tokens = l + m + r
            gold = {(i, i + 1): 0 for i in range(len(tokens)) if not c or not len(l) <= i < len(l) + len(m)}
            if c:
                gold[len(l), len(l) + len(m)] = c
            data.append((lattice(tokens), gold))
    w = np.zeros((len(KINDS) + 1, 1 << BITS))
    square = np.full_like(w, 1e-2)
    for _ in range(ROUNDS):
        rng.shuffle(data)
        for g, gold in data:
            p = gradient(g, w, gold)
            step = np.zeros_like(w)
            for c in range(len(w)):
                np.add.at(step[c], g.features, p[c][:, None])
            used = np.flatnonzero(step.any(0))
            d = step[:, used]
            square[:, used] += d * d
            w[:, used] -= 0.3 * d / np.sqrt(square[:, used])
    return w


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", regions_: int = TRAIN_REGIONS) -> np.ndarray | None:
    """Weights from the base spans of the documents with the least hashes of their ids (``regions_`` rows at most)."""
    def make():
        def run(texts):
            out = []
            for t in texts:
                found = base_spans(t)
                out.append([{"left": t[max(0, s - 30):s], "span": t[s:e], "right": t[e:e + 30], "kind": k} for k, s, e in found[:8]])
            return {"found": out}
        return run

    rows = df.select(F.xxhash64(F.col(key)).alias("at"), F.col(text).alias("text")).where(F.col("text").rlike("[0-9]{2}|@"))
    some = map_texts(rows, ["at"], "text", make, "found array<struct<left:string,span:string,right:string,kind:int>>").where("size(found) > 0")
    got = some.orderBy("at", F.xxhash64("found")).limit(regions_).collect()
    return train([(x["left"], x["span"], x["right"], x["kind"]) for r in got for x in r["found"]][:regions_])


def spans(text: str, w: np.ndarray | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: added ones touch no base span."""
    base = base_spans(text)
    if w is None:
        return base, base
    more = []
    for at, tokens in regions(text):
        end = at + sum(map(len, tokens))
        own = [b for b in base if b[1] < end and b[2] > at]
        places = np.cumsum([at, *map(len, tokens)])
        owned = np.zeros(len(tokens), bool)  # tokens that base spans touch
        for _, s, e in own:
            owned[max(0, np.searchsorted(places, s, "right") - 1):np.searchsorted(places, e)] = True
        free = [any(c.isdigit() or c == "@" for c in t) and not o for t, o in zip(tokens, owned.tolist())]
        if not any(free) and "at" not in map(str.lower, tokens):
            continue
        for kind, i, j, gain in best(tokens, w):
            # a single token too, if it is a number: longer segments hold a digit or an at
            if gain >= MARGIN and (j - i > 1 or "0" <= tokens[i][0] <= "9") and not owned[i:j].any():
                more.append((kind, int(places[i]), int(places[j])))
    return base, sorted({*base, *more})


def as_string(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def scan(df: DataFrame, w: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of the base kinds, the base spans' digest and all spans."""
    sent = df.sparkSession.sparkContext.broadcast(w)

    def make():
        def run(texts):
            got = [spans(t, sent.value) for t in texts]
            count = lambda k: np.array([sum(x[0] == k for x in b) for b, _ in got], np.int64)
            return {"n_email": count(0), "n_ip": count(1), "n_card": count(2), "n_phone": count(3),
                    "base_sha256": [sha256(as_string(b).encode()).hexdigest() for b, _ in got], "spans": [as_string(a) for _, a in got]}
        return run

    return map_texts(df, [key], text, make, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
