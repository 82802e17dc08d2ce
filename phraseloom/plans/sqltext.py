"""DuckDB expressions for the SQL counterparts."""

from __future__ import annotations

from phraseloom import constants as C


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def qs(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def _pattern() -> str:
    return "|".join(C.token_forms("?i"))


def tokenize(text: str) -> str:
    tail = C.CLITIC_TAIL
    words = lambda s: f"CASE WHEN lower({s}) = 'cannot' THEN [substring({s}, 1, 3), substring({s}, 4, 3)] ELSE [{s}] END"
    stem = f"regexp_extract(t, {q(f'(?is)^(.+?)({tail}*)$')}, 1)"
    split = (
        f"CASE WHEN contains(t, '''') OR contains(t, '’') THEN list_transform([{stem}], lambda s: "
        f"list_concat({words('s')}, regexp_extract_all(substring(t, length(s) + 1), {q('(?i)' + tail)})))[1] ELSE {words('t')} END"
    )
    return f"flatten(list_transform(regexp_extract_all({text}, {q(_pattern())}), lambda t: {split}))"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def lemma(word: str, verb: str = "false") -> str:
    bare = f"regexp_replace(trim(lower({word}), {q(C.STRIP_CHARS)}), '[''’]s$', '')"
    cut = lambda k: f"substring(t, 1, length(t) - {k})"
    return (
        f"list_transform([{bare}], lambda t: CASE WHEN ({verb}) AND t IN {qs(C.IRREGULAR_VERBS)} THEN {_map(C.IRREGULAR_VERBS)}[t] "
        f"WHEN t IN {qs(C.IRREGULAR)} THEN {_map(C.IRREGULAR)}[t] "
        rf"WHEN length(t) <= 3 OR NOT regexp_full_match(t, '[\p{{L}}\p{{Nl}}\p{{M}}]+') THEN t "
        f"WHEN t LIKE '%ies' AND length(t) > 4 THEN {cut(3)} || 'y' "
        f"WHEN regexp_matches(t, '(ss|sh|ch|x|z|s)es$') THEN {cut(2)} "
        f"WHEN t LIKE '%ing' AND length(t) > 5 THEN {cut(3)} "
        f"WHEN t LIKE '%ied' AND length(t) > 4 THEN {cut(3)} || 'y' "
        f"WHEN t LIKE '%ed' AND length(t) > 4 THEN {cut(2)} "
        f"WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN {cut(1)} ELSE t END)[1]"
    )


def trim(text: str) -> str:
    return f"regexp_replace({text}, {q(f'^[{C.BLANK}]+|[{C.BLANK}]+$')}, '', 'g')"


def is_slot(token: str) -> str:
    return rf"(regexp_matches({trim(token)}, '^[\[(<⟨].*[\])>⟩]$') OR lower({trim(token)}) IN {qs(C.SLOT_WORDS)})"


def slot_type(token: str) -> str:
    t = f"lower({trim(token)})"
    return f"CASE WHEN {t} IN {qs(C.PRONOUN_SLOTS)} THEN 'slot:pron' WHEN {t} IN {qs(C.NOUN_SLOTS)} THEN 'slot:noun' ELSE 'slot' END"


def lemma_eq(a: str, b: str) -> str:
    one = lambda x, y: f"(length({x}) >= {C.SHORTEST_STEM} AND starts_with({y}, {x}) AND substring({y}, length({x}) + 1) IN {qs(C.INFLECTIONS)})"
    return f"({a} = {b} OR {one(a, b)} OR {one(b, a)})"


def elements(phrase: str) -> str:
    """Pattern of a headword, as list of lists."""
    words = f"list_filter({tokenize(phrase)}, lambda w: w NOT IN {qs(C.CLITICS)})"
    raw = f"list_transform({words}, lambda w: CASE WHEN {is_slot('w')} THEN [{slot_type('w')}] ELSE ['w', {lemma('w')}] END)"
    slot = lambda l, i: f"coalesce({l}[{i}][1] <> 'w', false)"  # noqa: E731,E741
    kept = f"list_filter(r, lambda e, i: NOT (e[1] = 'w' AND e[2] IN {qs(C.CONNECTORS)} AND i > 1 AND {slot('r', 'i - 1')} AND {slot('r', 'i + 1')}))"
    merged = (
        f"list_filter(list_transform(k, lambda e, i: CASE WHEN e[1] = 'w' THEN e WHEN i > 1 AND {slot('k', 'i - 1')} THEN NULL "
        f"WHEN {slot('k', 'i + 1')} THEN ['slot'] ELSE e END), lambda e: e IS NOT NULL)"
    )
    return f"list_transform(list_transform([{raw}], lambda r: {kept}), lambda k: {merged})[1]"


def flat(elements_: str) -> str:
    """One string per pattern."""
    return f"array_to_string(list_transform({elements_}, lambda e: array_to_string(e, ':')), ' ')"


def plan(elements_: str) -> str:
    """List of {w, gap, slot} of the fixed words."""
    step = (
        "lambda e, i: CASE WHEN e[1] = 'w' THEN {'w': coalesce(e[2], ''), "
        f"'gap': CASE WHEN len(list_filter(x[1:i-1], lambda y: y[1] = 'w')) = 0 THEN 0 WHEN x[i-1][1] <> 'w' THEN {C.SLOT_MAX} ELSE {C.GAP_MAX} END, "
        "'slot': CASE WHEN len(list_filter(x[1:i-1], lambda y: y[1] = 'w')) > 0 AND x[i-1][1] <> 'w' THEN x[i-1][1] ELSE 'slot' END} END"
    )
    return f"list_transform([{elements_}], lambda x: list_filter(list_transform(x, {step}), lambda s: s IS NOT NULL))[1]"


def siphash13_low32(words: str) -> str:
    """SQL of (word, id): the low 32 bits of SipHash-1-3 with zero keys over the word's bytes and 0xFF; ``words`` has a column word.

    64-bit words are HUGEINTs cut back after each sum; a round is four nested
    selections, as each step reads what the one before wrote.
    """
    top = str((1 << 64) - 1) + "::HUGEINT"
    cut = lambda x: f"(({x}) & {top})"
    turn = lambda v, n: f"({cut(f'{v} << {n}')} | ({v} >> {64 - n}))"

    def one_round(source: str, keep: str) -> str:
        for a, b, c, d in (
            (cut("v0 + v1"), turn("v1", 13), cut("v2 + v3"), turn("v3", 16)),
            (turn("v0", 32), "xor(v1, v0)", "v2", "xor(v3, v2)"),
            (cut("v0 + v3"), turn("v1", 17), cut("v2 + v1"), turn("v3", 21)),
            ("v0", "xor(v1, v2)", turn("v2", 32), "xor(v3, v0)"),
        ):
            source = f"(SELECT {keep}, {a} AS v0, {b} AS v1, {c} AS v2, {d} AS v3 FROM {source})"
        return source

    digit = lambda i: f"(instr('0123456789ABCDEF', substring(h, k * 16 + {i}, 1)) - 1)"
    block = " + ".join(f"({digit(2 * j + 1)} * 16 + {digit(2 * j + 2)})::HUGEINT * {1 << (8 * j)}::HUGEINT" for j in range(8))
    step = one_round(f"(SELECT word, h, n, k + 1 AS k, m, v0, v1, v2, xor(v3, m) AS v3 FROM (SELECT *, {block} AS m FROM r WHERE k < n))", "word, h, n, k, m")
    last = "(SELECT word, v0, v1, xor(v2, 255::HUGEINT) AS v2, v3 FROM r WHERE k = n)"
    for _ in range(3):
        last = one_round(last, "word")
    start = ", ".join(f"{int.from_bytes(x, 'big')}::HUGEINT AS v{i}" for i, x in enumerate((b"somepseu", b"dorandom", b"lygenera", b"tedbytes")))
    return f"""WITH RECURSIVE w AS (SELECT word, hex(encode(word)) || 'FF' AS h FROM {words}),
p AS (SELECT word, length(h) // 16 + 1 AS n, rpad(h, ((length(h) // 16 + 1) * 16 - 2)::int, '0') || printf('%02X', (length(h) // 2) % 256) AS h FROM w),
r AS (SELECT word, h, n, 0 AS k, {start} FROM p UNION ALL SELECT word, h, n, k, xor(v0, m) AS v0, v1, v2, v3 FROM {step})
SELECT word, (xor(xor(v0, v1), xor(v2, v3)) & 4294967295::HUGEINT)::bigint AS id FROM {last}"""
