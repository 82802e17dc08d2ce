"""Records that are the same but for white space, letter case, punctuation and field order.

Texts are streamed through one lookup table that skips or folds each code
unit, into polynomial hashes; a canonical string is never built.  Prefix
hashes over a whole batch give the hash of any piece in constant time, so a
JSON record is hashed piece by piece: object members and the members of
unordered arrays are added up, other arrays are chained in order.  The records
of a batch are put together level by level, from the innermost arrays and
objects outwards, as whole arrays, so how deep a record is nested does not
matter.  Rows whose 128-bit fingerprints agree are then compared with two
pointers that skip what the table skips.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.plans.lineage import cut_lineage, scratch_path

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64
_U = np.uint64

#: Symbols that count as punctuation, besides Unicode's own categories of it.
SYMBOLS = "`´^~|<>=+$¨"


@lru_cache(maxsize=4)
def fold_table(symbols: str = SYMBOLS) -> np.ndarray:
    """Code point -> folded code point, 0 for those that are skipped (white space, punctuation, controls)."""
    table = np.arange(0x110000, dtype=np.uint32)
    # ideographs, surrogates and private use fold to themselves
    for cp in chain(range(0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0xE0000, 0xE0200)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] == "P" or kind[0] == "Z" or kind in ("Cc", "Cf") or c in symbols:
            table[cp] = 0
        elif len(low := c.lower()) == 1:
            table[cp] = ord(low)
    return table


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _room(n: int) -> int:
    """A power of two above ``n``, so that few tables of powers are made."""
    return 1 << max(10, int(n).bit_length())


class PieceHasher:
    """Polynomial hashes of pieces of a buffer of code points, skipping and folding by the table."""

    def __init__(self, units: np.ndarray):
        folded = fold_table()[units]
        self.rank = np.concatenate(([0], np.cumsum(folded != 0)))  # kept units before each position
        size = _room(len(units))
        self.prefix, self.inverse = [], []
        for base in _BASES:
            terms = folded.astype(np.uint64) * _powers(base, size)[self.rank[:-1]]
            self.prefix.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64))))
            self.inverse.append(_powers(pow(base, -1, 1 << 64), size))

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Two arrays of hashes, one entry for each piece; pieces that keep the same units have the same hashes."""
        n = (self.rank[ends] - self.rank[starts]).astype(np.uint64)
        return [(prefix[ends] - prefix[starts]) * inverse[self.rank[starts]] + n for prefix, inverse in zip(self.prefix, self.inverse)]


def _mix(x: np.ndarray, tag: int) -> np.ndarray:
    """A bijection of 64 bits that scatters them (so that sums of members do not cancel)."""
    x = x + _U((tag * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _reject(name: str):
    raise ValueError(name)


_LEXEME = re.compile(r'[ \t\n\r]*("[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]|[^\s{}\[\],:"]+)', re.S)


def _parse_deep(text: str):
    """``json.loads`` with a stack of its own, for records nested too deep for the interpreter's."""
    holders: list = []  # open arrays and objects
    keys: list = []  # for each, the key its next value belongs to
    expect, at, done = "value", 0, None  # value, first (value or end), key, first key (key or end), colon, next, end
    while (m := _LEXEME.match(text, at)) is not None:
        token, at = m.group(1), m.end()
        if expect in ("key", "first key") and token[0] == '"':
            keys[-1] = json.loads(token)
            expect = "colon"
            continue
        if expect == "colon" and token == ":":
            expect = "value"
            continue
        if expect == "next" and token == ",":
            expect = "key" if isinstance(holders[-1], dict) else "value"
            continue
        if expect in ("value", "first") and token in "[{":
            holders.append([] if token == "[" else {})
            keys.append(None)
            expect = "first" if token == "[" else "first key"
            continue
        if (token == "]" and expect in ("next", "first") and isinstance(holders[-1], list)) or (token == "}" and expect in ("next", "first key") and isinstance(holders[-1], dict)):
            keys.pop()
            value = holders.pop()
        elif expect in ("value", "first") and token not in "]},:":
            value = json.loads(token, parse_constant=_reject)
        else:
            raise ValueError(token)
        if not holders:
            expect, done = "end", value
        else:
            expect = "next"
            if isinstance(holders[-1], dict):
                holders[-1][keys[-1]] = value
            else:
                holders[-1].append(value)
    if expect != "end" or text[at:].strip(" \t\n\r"):
        raise ValueError("not a whole value")
    return done


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``; None for null, malformed text and JSON that is not an object."""
    if text is None or "{" not in text:
        return None
    try:
        try:
            value = json.loads(text, parse_constant=_reject)
        except RecursionError:
            value = _parse_deep(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


_ESCAPED = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)+)"', re.S)


def _plain(match: re.Match) -> str:
    """A string with its escapes resolved, without the quotes and backslashes in it, which the table skips anyhow."""
    return '"' + json.loads(match.group(), strict=False).replace('"', "").replace("\\", "") + '"'


def _number(token: str) -> str:
    """Numbers are equal by value; letters stand for sign and point, which the table would skip."""
    if token in ("true", "false", "null"):
        return token
    value = json.loads(token)
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**63:
        value = int(value)
    return repr(value).replace("-", "m").replace(".", "p").replace("+", "")


_STRING, _OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY, _COLON, _COMMA, _BARE, _SPACE = range(9)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each character outside of strings."""
    table = np.full(128, _BARE, np.uint8)
    for marks, kind in ((" \t\n\r", _SPACE), ("{", _OPEN_OBJECT), ("}", _CLOSE_OBJECT), ("[", _OPEN_ARRAY), ("]", _CLOSE_ARRAY), (":", _COLON), (",", _COMMA), ('"', _STRING)):
        table[[ord(c) for c in marks]] = kind
    return table


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Tokens:
    """The tokens of valid records without backslashes: strings, brackets and bare values, with the hashes of their pieces."""

    def __init__(self, text: str, names: Sequence[str]):
        units = _units(text)
        quotes = np.flatnonzero(units == 34)
        starts, closes = quotes[0::2], quotes[1::2]
        step = np.zeros(len(units) + 1, np.int8)
        step[starts] = 1
        step[closes + 1] = -1
        outside = np.cumsum(step[:-1], dtype=np.int8) == 0
        kind = np.where(outside, _kinds()[np.minimum(units, 127)], np.uint8(_SPACE))
        marks = np.flatnonzero((kind != _BARE) & (kind != _SPACE))
        bare = np.flatnonzero(np.diff(np.concatenate(([0], (kind == _BARE).astype(np.int8), [0]))))
        bare_starts, bare_ends = bare[0::2], bare[1::2]
        # what is hashed of a bare value is its digits, or else the text of its value, put after the records
        digits = np.concatenate(([0], np.cumsum((units >= 48) & (units < 58))))
        odd = np.flatnonzero(digits[bare_ends] - digits[bare_starts] < bare_ends - bare_starts)
        values = [_number(text[a:b]) for a, b in zip(bare_starts[odd].tolist(), bare_ends[odd].tolist())]
        piece_starts, piece_ends = bare_starts.copy(), bare_ends.copy()
        extra = [*values, *names]
        ends = len(units) + np.cumsum(np.fromiter(map(len, extra), np.int64, len(extra)))
        begins = np.concatenate(([len(units)], ends[:-1])) if extra else ends
        piece_starts[odd], piece_ends[odd] = begins[: len(odd)], ends[: len(odd)]

        at = np.concatenate((starts, marks, bare_starts))
        order = np.argsort(at, kind="stable")
        kinds = np.concatenate((np.full(len(starts), _STRING, np.uint8), kind[marks], np.full(len(bare_starts), _BARE, np.uint8)))[order]
        nothing = np.zeros(len(marks), np.int64)
        first = np.concatenate((starts + 1, nothing, piece_starts))[order]
        last = np.concatenate((closes, nothing, piece_ends))[order]
        self.text, self.at = text, at[order]
        is_key = np.zeros(len(kinds), bool)
        is_key[:-1] = (kinds[:-1] == _STRING) & (kinds[1:] == _COLON)
        keep = (kinds != _COLON) & (kinds != _COMMA)
        self.kind, self.is_key, self.at, self.first, self.last = kinds[keep], is_key[keep], self.at[keep], first[keep], last[keep]
        hasher = PieceHasher(np.concatenate((units, _units("".join(extra)))))
        self.piece = hasher.pieces(self.first, self.last)
        self.names = hasher.pieces(begins[len(odd) :], ends[len(odd) :])
        null = ord("n")
        self.null = (self.kind == _BARE) & (units[np.minimum(self.at, len(units) - 1)] == null)


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of slices modulo 2**64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[hi] - total[lo]


def _record_hashes(t: _Tokens) -> list[np.ndarray]:
    """Two hashes for each outermost object, put together from the innermost level outwards."""
    opens, closes = (t.kind == _OPEN_OBJECT) | (t.kind == _OPEN_ARRAY), (t.kind == _CLOSE_OBJECT) | (t.kind == _CLOSE_ARRAY)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    within = depth - opens  # how many containers a value is in
    is_value = ~closes & ~t.is_key
    null = t.null.copy()
    inner = [np.where(t.kind == _STRING, _mix(h, 3 + k), _mix(h, 19 + k)) for k, h in enumerate(t.piece)]

    values = np.flatnonzero(is_value)
    values = values[np.argsort(within[values], kind="stable")]  # by level, in order within a level
    level_at = np.searchsorted(within[values], np.arange(depth.max(initial=0) + 2))
    containers = np.flatnonzero(opens)
    containers = containers[np.argsort(depth[containers], kind="stable")]
    container_at = np.searchsorted(depth[containers], np.arange(depth.max(initial=0) + 2))
    for level in range(int(depth.max(initial=0)), 0, -1):
        own = containers[container_at[level] : container_at[level + 1]]
        v = values[level_at[level] : level_at[level + 1]]
        lo = np.searchsorted(v, own)
        hi = np.append(lo[1:], len(v))
        owner = np.repeat(np.arange(len(own)), hi - lo)
        in_object = t.kind[own][owner] == _OPEN_OBJECT
        key = v - 1  # of a member of an object
        absent = null[v] & in_object
        _drop_repeated(t, v, key, owner, in_object, absent)
        free = np.zeros(len(own), bool)
        for a, b in zip(*(x.tolist() for x in t.names)):
            before = np.maximum(own - 1, 0)
            free |= t.is_key[before] & (t.piece[0][before] == _U(a)) & (t.piece[1][before] == _U(b))
        place = (hi - lo)[owner] - 1 - (np.arange(len(v)) - lo[owner])
        members = hi - lo
        for k in (0, 1):
            h = np.where(null[v] & ~in_object, _U(0x5EED + k), inner[k][v])
            as_member = np.where(absent, _U(0), _mix(t.piece[k][key] ^ (h * _U(5)), 7 + k))
            chained = h * _powers(_BASES[k], _room(int(members.max(initial=0))))[place]
            parts = np.where(in_object, as_member, np.where(free[owner], _mix(h, 13 + k), chained))
            total = _sums(parts, lo, hi)
            object_ = t.kind[own] == _OPEN_OBJECT
            inner[k][own] = np.where(object_, _mix(total, 11 + k), _mix(total + members.astype(np.uint64), 17 + k))
    roots = containers[container_at[1] : container_at[2]] if len(containers) else containers
    return [h[roots] for h in inner]


def _drop_repeated(t: _Tokens, v: np.ndarray, key: np.ndarray, owner: np.ndarray, in_object: np.ndarray, absent: np.ndarray) -> None:
    """Mark members whose exact key comes again later in their object as absent: the last one holds."""
    at = np.flatnonzero(in_object)
    if len(at) < 2:
        return
    hashes = t.piece[0][key[at]]
    order = np.lexsort((hashes, owner[at]))
    same = (owner[at][order][1:] == owner[at][order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    if not same.any():
        return
    last: dict[tuple, int] = {}
    touched = np.flatnonzero(np.append(same, False) | np.append(False, same))
    for i in np.sort(at[order[touched]]).tolist():
        name = (int(owner[i]), t.text[t.first[key[i]] : t.last[key[i]]])
        if name in last:
            absent[last[name]] = True
        last[name] = i


def fingerprints(texts: Sequence[str | None], unordered: Sequence[str] = ("categories", "tags")) -> list[bytes | None]:
    """A 16-byte fingerprint for each text that holds a JSON object, else None."""
    good = [i for i, text in enumerate(texts) if parse_object(text) is not None]
    found: list[bytes | None] = [None] * len(texts)
    if good:
        records = "\n".join(_ESCAPED.sub(_plain, texts[i]) if "\\" in texts[i] else texts[i] for i in good)
        a, b = _record_hashes(_Tokens(records, unordered))
        both = np.stack((a, b), axis=1).astype(">u8").tobytes()
        for n, i in enumerate(good):
            found[i] = both[16 * n : 16 * n + 16]
    return found


def same_text(a: str, b: str) -> bool:
    """Two-pointer comparison that steps over what the table skips."""
    table = fold_table()
    i = j = 0
    n, m = len(a), len(b)
    while True:
        while i < n and not table[ord(a[i])]:
            i += 1
        while j < m and not table[ord(b[j])]:
            j += 1
        if i == n or j == m:
            return i == n and j == m
        if a[i] != b[j] and table[ord(a[i])] != table[ord(b[j])]:
            return False
        i += 1
        j += 1


def _match_free(xs: list, ys: list, unordered: Sequence[str]) -> bool:
    """Both lists hold equal members in some order (equality is transitive, so greedy matching is exact)."""
    rest = list(ys)
    for x in xs:
        for k, y in enumerate(rest):
            if same_value(x, y, unordered):
                del rest[k]
                break
        else:
            return False
    return not rest


def same_value(x, y, unordered: Sequence[str], key: str | None = None) -> bool:
    """Equality of two parsed JSON values with formatting set aside."""
    if isinstance(x, str) and isinstance(y, str):
        return x == y or same_text(x, y)
    if isinstance(x, dict) and isinstance(y, dict):
        xs = [(k, v) for k, v in x.items() if v is not None]
        rest = [(k, v) for k, v in y.items() if v is not None]
        if len(xs) != len(rest):
            return False
        for k, v in xs:
            for i, (k2, v2) in enumerate(rest):
                if (k == k2 or same_text(k, k2)) and same_value(v, v2, unordered, k):
                    del rest[i]
                    break
            else:
                return False
        return True
    if isinstance(x, list) and isinstance(y, list):
        if len(x) != len(y):
            return False
        if key is not None and any(key == u or same_text(key, u) for u in unordered):
            return _match_free(x, y, unordered)
        return all(same_value(a, b, unordered) for a, b in zip(x, y))
    if isinstance(x, bool) or isinstance(y, bool) or x is None or y is None:
        return x is y
    return isinstance(x, (int, float)) and isinstance(y, (int, float)) and x == y


def _exact_key(value, unordered: Sequence[str]) -> str:
    """Canonical text, for rows with equal fingerprints and different content, and for what is nested too deep to compare."""
    table = fold_table()
    squeeze = lambda s: "".join(chr(table[ord(c)]) for c in s if table[ord(c)])
    done: list[str] = []  # texts of finished values
    todo: list[tuple] = [(value, None, False)]
    while todo:
        value, key, entered = todo.pop()
        if isinstance(value, (dict, list)) and not entered:
            todo.append((value, key, True))
            pairs = [(v, k) for k, v in value.items() if v is not None] if isinstance(value, dict) else [(v, None) for v in value]
            todo += [(v, k, False) for v, k in reversed(pairs)]
        elif isinstance(value, dict):
            names = [k for k, v in value.items() if v is not None]
            parts = done[len(done) - len(names) :] if names else []
            del done[len(done) - len(names) :]
            done.append("{" + ",".join(sorted(squeeze(k) + ":" + p for k, p in zip(names, parts))) + "}")
        elif isinstance(value, list):
            parts = done[len(done) - len(value) :] if value else []
            del done[len(done) - len(value) :]
            if key is not None and any(same_text(key, u) for u in unordered):
                parts.sort()
            done.append("[" + ",".join(parts) + "]")
        elif isinstance(value, str):
            done.append('"' + squeeze(value))
        else:
            done.append(repr(int(value) if isinstance(value, float) and value.is_integer() else value))
    return done[0]


def _comparison_key(first: str, text: str, unordered: Sequence[str]) -> str | None:
    """None if both texts are copies, else what ``text`` is grouped by instead."""
    if first == text:
        return None
    x, y = parse_object(first), parse_object(text)
    try:
        if same_value(x, y, unordered):
            return None
    except RecursionError:
        if _exact_key(x, unordered) == _exact_key(y, unordered):
            return None
    return _exact_key(y, unordered)


#: Characters that are hashed at once, but for a record that is longer; and records at most.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 8192


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded total length."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > BATCH_CHARS or i - start == BATCH_ROWS):
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def fingerprint_rows(rows: DataFrame, id_col: str, text_col: str, unordered: Sequence[str] = ("categories", "tags")) -> DataFrame:
    """(id, text, fingerprint) for each row whose text is a JSON object; the others are left out."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                marks = pa.array(fingerprints(texts[lo:hi], unordered), pa.binary())
                part = batch.slice(lo, hi - lo)
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), marks], ["_id", "_text", "_mark"])
                yield out.filter(marks.is_valid())

    # JSON objects hold a brace: the scan drops null, blank and most malformed lines.
    source = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").contains("{"))
    return source.mapInArrow(run, f"_id {kind}, _text string, _mark binary")


def marked_records(rows: DataFrame, id_col: str, text_col: str, unordered: Sequence[str] = ("categories", "tags")) -> DataFrame:
    """``fingerprint_rows`` as a table in the shared folder, so each record is fingerprinted once and columns are read apart."""
    path = scratch_path(rows.sparkSession)
    fingerprint_rows(rows, id_col, text_col, unordered).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def copies_among(marked: DataFrame, unordered: Sequence[str] = ("categories", "tags")) -> DataFrame:
    """``copies`` of records that have their fingerprints already (see ``marked_records``)."""
    shared = marked.groupBy("_mark").agg(F.min("_id").alias("_first_id"), F.count("*").alias("_n")).where("_n > 1").select("_mark", "_first_id")
    members = cut_lineage(marked.join(shared, "_mark"))  # only rows whose fingerprint another row has
    firsts = members.where("_id = _first_id").groupBy("_mark").agg(F.first("_text").alias("_first_text"))
    pairs = members.join(firsts, "_mark").select("_mark", "_first_id", "_id", "_first_text", "_text")
    kind = marked.schema["_id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_comparison_key(a, b, unordered) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.string())], ["_mark", "_first_id", "_id", "_key"])

    verified = cut_lineage(pairs.mapInArrow(verify, f"_mark binary, _first_id {kind}, _id {kind}, _key string"))
    same = verified.where("_key is null").select("_first_id", "_id")
    other = verified.where("_key is not null")
    regrouped = other.join(other.groupBy("_mark", "_key").agg(F.min("_id").alias("_own_first")), ["_mark", "_key"]).select(F.col("_own_first").alias("_first_id"), "_id")
    return same.unionByName(regrouped).select(F.col("_first_id").alias("first_id"), F.col("_id").alias("id"))


def copies(rows: DataFrame, id_col: str, text_col: str, unordered: Sequence[str] = ("categories", "tags")) -> DataFrame:
    """(first_id, id) for each record that is a copy of another, the first of each group included.

    A group is every row whose text is a JSON object with the same keys and
    values once white space, letter case, punctuation, key order, the order of
    ``unordered`` arrays, and null against missing keys are set aside; its
    first row is the one with the smallest id (ids are unique).  Of a key that
    an object repeats the last value holds.  Null, blank and malformed texts
    and JSON that is no object are no records and do not appear; depth of
    nesting and length are no bounds.

    Records are fingerprinted once and written with their texts, as columns:
    counting reads fingerprints and ids only, with partial aggregation.  Rows
    whose fingerprint is shared join by it with the text of their first row, so
    a group with a third of all rows is one row on one side and is split by
    adaptive execution on the other.  Each is verified against its first with
    two pointers, once; rows that turn out to differ are grouped by their
    exact content instead.
    """
    return copies_among(marked_records(rows, id_col, text_col, unordered), unordered)


def distinct_records(rows: DataFrame, id_col: str, text_col: str, unordered: Sequence[str] = ("categories", "tags")) -> DataFrame:
    """(id, copies): each record once, by its first row, with its number of copies (1 where there are no others)."""
    marked = marked_records(rows, id_col, text_col, unordered)
    found = copies_among(marked, unordered)
    alone = marked.select(F.col("_id").alias("id")).join(found.select("id"), "id", "left_anti").withColumn("copies", F.lit(1).cast("bigint"))
    return found.groupBy(F.col("first_id").alias("id")).agg(F.count("*").alias("copies")).unionByName(alone).withColumnRenamed("id", id_col)
