"""Renaming inside the row (T2–T12): the slices of ``lookup.map_lists``.

The tokens of a slice of rows are numbered by spelling, so the rule cascade is
evaluated once a spelling, and an entity is a pair (row, spelling).  Aliases
are numbered by sorting the entities of a class by their first use.  Nothing is
exploded, joined or collected again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import constants as K
from ..functions import patterns as R
from .lookup import list_of

KEEP, LIT, NAME, STRUCT, CLASS = range(5)
ALIAS_CLASSES = ["var", "func", "lit", "struct", "class"]


def _numpy(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _spelled(elements: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct elements (null is one of them) and each element's number among them."""
    coded = pc.dictionary_encode(elements, null_encoding="encode")
    return coded.dictionary, _numpy(coded.indices).astype(np.int64)


def _kinds(words: pa.Array, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``tokens.occurrence_kind`` for each occurrence."""
    def listed(values):
        return _numpy(pc.is_in(words, value_set=pa.array(values, words.type)))

    def matched(pattern):
        return _numpy(pc.fill_null(pc.match_substring_regex(words, pattern), False))

    fixed, name = listed(K.KEYWORDS + K.SPECIAL_NAMES), matched(R.IDENT_FULL_RE2)
    plain = np.select([fixed | listed(K.TYPE_WORDS + K.STD_FUNCTIONS), matched(R.LITERAL_START_RE), name], [KEEP, LIT, NAME], KEEP)
    head = np.select([listed(["class"]), listed(["struct"])], [CLASS, STRUCT], KEEP)
    before = np.concatenate([[KEEP], head[code[:-1]]]) if len(code) else head[code]
    before[starts] = KEEP
    return np.where((before != KEEP) & name[code] & ~fixed[code], before, plain[code])


def renamed(_, elements: pa.Array, sizes: np.ndarray) -> list[pa.Array]:
    """T1–T11 for a slice of rows: the renamed tokens and the five maps."""
    n, row = len(elements), np.repeat(np.arange(len(sizes)), sizes)
    words, code = _spelled(elements)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    kind = _kinds(words, code, starts)
    called = np.zeros(n, bool)
    called[:-1] = _numpy(pc.fill_null(pc.equal(words, "("), False))[code[1:]]
    called[starts[1:] - 1] = False

    used = np.flatnonzero(kind != KEEP)
    keys, at = np.unique(row[used] * len(words) + code[used], return_inverse=True)
    entity = np.zeros(n, np.int64)
    entity[used] = at

    def first(where):
        """First use of each entity among the occurrences ``where``; n if there is none."""
        out, places = np.full(len(keys), n), np.flatnonzero(where)[::-1]
        out[entity[places]] = places
        return out

    lit, struct, cls, name = (first(kind == k) for k in (LIT, STRUCT, CLASS, NAME))
    plain = (name < n) & (struct > name) & (cls > name)        # no declaration before its first plain use
    call = first((kind == NAME) & called) == name
    firsts = [np.where(plain & ~call, name, n), np.where(plain & call, name, n), lit, struct, cls]
    of_row, of_word = np.divmod(keys, max(len(words), 1))

    aliases, maps, given, total = [], [], [], len(words)
    for prefix, uses in zip(ALIAS_CLASSES, firsts):
        order = np.flatnonzero(uses < n)
        order = order[np.argsort(uses[order])]                 # by row, then by first use
        rows = of_row[order]
        number = np.arange(len(order)) - np.searchsorted(rows, rows)
        made = pc.binary_join_element_wise(prefix, pa.array(number).cast(words.type), "")
        place = np.full(len(keys), -1)
        place[order] = total + np.arange(len(order))
        total += len(order)
        given.append(place)
        aliases.append(made)
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sizes)))])
        maps.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(of_word[order])), made))

    var, func, lit_at, struct_at, class_at = (np.append(g, -1)[entity] for g in given)
    resolved = np.where(var >= 0, var, func)
    declared = np.where(np.append(struct, n)[entity] < np.arange(n), struct_at, class_at)
    alias = np.select([kind == LIT, kind == STRUCT, kind == CLASS, kind == NAME],
                      [lit_at, struct_at, class_at, np.where(resolved >= 0, resolved, declared)], -1)
    stripped = pc.replace_substring(pc.replace_substring(words, "\r", ""), "\n", "")    # P10
    spellings = pa.concat_arrays([stripped, *aliases])
    return [list_of(sizes, spellings.take(pa.array(np.where(alias >= 0, alias, code)))), *maps]


def restored(rows: pa.RecordBatch, elements: pa.Array, sizes: np.ndarray) -> list[pa.Array]:
    """T12 for a slice of rows: aliases back to names by the row's own lists
    ``_alias`` and ``_name`` (null: no names)."""
    aliases, names = (rows.column(rows.schema.names.index(c)) for c in ("_alias", "_name"))
    own = _numpy(pc.fill_null(pc.list_value_length(aliases), 0)).astype(np.int64)
    n, names = len(elements), names.flatten()
    words, code = _spelled(pa.concat_arrays([elements, aliases.flatten()]))
    key = np.repeat(np.tile(np.arange(len(sizes)), 2), np.concatenate([sizes, own])) * len(words) + code
    order = np.argsort(key[n:], kind="stable")
    known = key[n:][order]
    if (known[1:] == known[:-1]).any():
        raise ValueError("an alias stands for two names of its row")
    at = np.minimum(np.searchsorted(known, key[:n]), max(len(known) - 1, 0))
    found = known[at] == key[:n] if len(known) else np.zeros(n, bool)
    place = np.arange(n)
    place[found] = n + order[at[found]]
    return [list_of(sizes, pa.concat_arrays([elements, names]).take(pa.array(place)))]


def _changes(values: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls equal each other."""
    code = _spelled(values)[1]
    return code[1:] != code[:-1]


def merged_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """T15 on ``(id, piece, parent)`` in order: ``(id, pos, token)``, an island a
    row.  ``held`` is the last island so far, ``at`` its place in its row."""
    held, at = None, 0

    def of(rows: pa.RecordBatch, last: bool):
        ids, pieces, parents = rows.columns
        opens = np.concatenate([[True], _changes(ids)])
        alone = ~_numpy(parents.is_valid())
        starts = np.concatenate([[True], opens[1:] | alone[1:] | alone[:-1] | _changes(parents)])
        first = np.flatnonzero(starts)
        heads = opens[first]                                   # islands that open a row
        heads[0] = at == 0
        number = np.arange(len(first))
        base = np.maximum.accumulate(np.where(heads, number, -1))
        pos = np.where(base >= 0, number - base, number + at)
        n = len(first) if last else len(first) - 1
        ends = np.append(first, len(starts))[:n + 1]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.fill_null(pieces, ""))
        token = pc.binary_join(lists, "")
        made = pa.RecordBatch.from_arrays([ids.take(pa.array(first[:n])), pa.array(pos[:n]), token], [rows.schema.names[0], "pos", "token"])
        return made, rows.slice(int(first[-1])), int(pos[-1])

    for batch in batches:
        if batch.num_rows:
            rows = batch if held is None else pa.concat_batches([held, batch])
            made, held, at = of(rows, False)
            yield made
    if held is not None:
        yield of(held, True)[0]
