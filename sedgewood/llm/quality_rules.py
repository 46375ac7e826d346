"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged by itself; failing lines are removed, and a document that loses too much text, or that
fails the base rules, is rejected.

Line rules: navigation (two ``|`` or more), symbols (over a tenth of the line is ``#*$%&|<>``), shouting (three words
or more, letters A-Z and none of a-z), fragment (no sentence end anywhere), boilerplate (holds one of ``BOILERPLATE``
as words of its own, and has ``BOILER_WORDS`` words at most or a fifth of its characters in such phrases).  A document
is rejected if over a fifth of its text is in lines that fail the first four, or over half in lines that fail any: a
license line alone says nothing against the rest.

Base rules: fewer than 10 words, or over a fifth of the words in five-word windows that the text has twice or more.
Windows are compared by 64-bit hash, within one text.

Defined cases: a null text has no words and is rejected by the base rules; repeated rows are judged alike; an empty
table gives an empty result; other columns are carried along by ``clean_stage``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sedgewood.llm._state import fresh

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOSS_PERCENT, REPEAT_WINDOW = 10, 20, 20, 5
#: Words of a line that one phrase makes boilerplate; percent of a text that may go with boilerplate.
BOILER_WORDS, MAX_REMOVED_PERCENT = 20, 50

#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "cookie", "terms of use", "terms of service",
    "privacy policy", "subscribe", "sign up", "javascript", "click here",
    "alle rechte vorbehalten", "nutzungsbedingungen", "hier klicken", "tous droits réservés", "mentions légales",
    "cliquez ici", "todos los derechos reservados", "aviso legal", "haz clic aquí",
)

_SYMBOLS = "#*$%&|<>"
_SPACE = r"[\\x20\\x09-\\x0D]"
_WORD = r"[^\\x20\\x09-\\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FAILS = (
    "(length(l) - length(replace(l, '|', '')) >= 2"
    f" or 10 * (length(l) - length(translate(l, '{_SYMBOLS}', ''))) > length(l)"
    f" or (not l rlike '[a-z]' and l rlike '[A-Z]' and l rlike '{_WORD}{_SPACE}+{_WORD}+{_SPACE}+{_WORD}')"
    r" or not l rlike '[.!?…]([\\s\"”»)]|$)')"
)
_PHRASE = "(^|[^a-z0-9_])(" + "|".join(BOILERPLATE) + ")s?($|[^a-z0-9_])"


def _boiler(low: str, words: str, match: str) -> str:
    """Whether a line is boilerplate, from the names of its lower case and its number of words and the form of a match."""
    rest = low
    for phrase in BOILERPLATE:
        rest = f"replace({rest}, '{phrase}', '')"
    return f"({match.format(low, _PHRASE)} and ({words} <= {BOILER_WORDS} or 5 * (length({low}) - length({rest})) >= length({low})))"


def measured(df: DataFrame, text_col: str, prefix: str, clean: bool = False) -> DataFrame:
    """df with columns ``prefix_...``: all measures, base_failed, kept and, if asked for, the cleaned text of each row."""
    t, w, n, h, s, p, low, has, marks, lines = (f"{prefix}_{x}" for x in ("t", "w", "n", "h", "s", "p", "low", "has", "marks", "lines"))
    k = REPEAT_WINDOW
    window = ", ".join(f"{w}[i + {j}]" for j in range(k))
    out = df.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    any_phrase = " or ".join(f"contains({low}, '{phrase}')" for phrase in BOILERPLATE)
    out = out.withColumns({w: F.expr(f"filter(split({t}, '{_SPACE}+'), x -> x <> '')"), low: F.lower(t)}).withColumn(has, F.expr(any_phrase))
    boiler = _boiler(f"translate(l, '{_UPPER}', '{_LOWER}')", f"size(filter(split(l, '{_SPACE}+'), x -> x <> ''))", "{0} rlike '{1}'")
    # each line with 0, or 1 if it fails, 2 if it is boilerplate, -1 if it has no word
    mark = f"transform(split({t}, '\\n'), l -> struct(l as l, case when not l rlike '{_WORD}' then -1 when {_FAILS} then 1 {{0}} else 0 end as m))"
    # the condition on the text stays outside: within, it would be computed for each line
    out = out.withColumn(marks, F.expr(f"if({has}, {mark.format(f'when {boiler} then 2')}, {mark.format('')})"))
    out = out.withColumn(lines, F.expr(f"filter({marks}, x -> x.m >= 0).l"))
    out = out.withColumns({n: F.expr(f"size({w})"), h: F.expr(f"if(size({w}) < {k}, cast(array() as array<bigint>), transform(sequence(0, size({w}) - {k}), i -> xxhash64({window})))")})
    # only texts that have a window twice are sorted
    out = out.withColumn(s, F.expr(f"if(size(array_distinct({h})) = size({h}), null, sort_array(transform({h}, (x, i) -> struct(x as h, i as i))))"))
    twice = f"get({s}, j - 1).h <=> x.h or get({s}, j + 1).h <=> x.h"
    out = out.withColumn(p, F.expr(f"sort_array(transform(filter({s}, (x, j) -> {twice}), x -> x.i))"))
    repeat = f"coalesce(aggregate(transform({p}, (x, j) -> least({k}, coalesce(get({p}, j + 1) - x, {k}))), 0L, (a, x) -> a + x), 0L)"
    chars = "aggregate({0}, 0L, (a, x) -> if(x.m {1}, a + length(x.l), a))"
    parts = {
        "n_words": f"cast({n} as bigint)",
        "word_chars": f"cast(length(translate({t}, ' \\t\\n\\u000b\\u000c\\r', '')) as bigint)",
        "n_symbols": f"cast(length({t}) - length(translate({t}, '{_SYMBOLS}', '')) as bigint)",
        "n_dup_lines": f"cast(size({lines}) - size(array_distinct({lines})) as bigint)",
        "n_repeat_words": repeat,
        "line_chars": chars.format(marks, ">= 0"),
        "lost_chars": chars.format(marks, "= 1"),
        "removed_chars": chars.format(marks, "> 0"),
    }
    if clean:
        parts["text"] = f"if(exists({marks}, x -> x.m > 0), array_join(filter({marks}, x -> x.m <= 0).l, '\\n'), {t})"
    # generated, not projected: a filter on a measure is not pushed below, where all of them would be computed again
    out = out.select(*df.columns, F.inline(F.array(F.struct(*(F.expr(e).alias(f"{prefix}_{c}") for c, e in parts.items())))))
    base = f"({prefix}_n_words < {MIN_WORDS} or 100 * {prefix}_n_repeat_words > {MAX_REPEAT_PERCENT} * {prefix}_n_words)"
    kept = f"not {base} and 100 * {prefix}_lost_chars <= {MAX_LOSS_PERCENT} * {prefix}_line_chars and 100 * {prefix}_removed_chars <= {MAX_REMOVED_PERCENT} * {prefix}_line_chars"
    return out.withColumns({f"{prefix}_base_failed": F.expr(base), f"{prefix}_kept": F.expr(kept)})


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "lost_chars", "removed_chars")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, the measures, base_failed and kept."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return measured(slim, "text", "q").select("doc_id", *(F.col(f"q_{c}").alias(c) for c in _COLUMNS))


def clean_stage(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of df that are kept, without their failing and boilerplate lines; a text with no such line is unchanged.

    ``chars_col``, where df has it, gets the length of the cleaned text.
    """
    q = "q"
    while any(c.lower().startswith(f"{q}_") for c in df.columns):
        q = fresh(df, q + "q")
    out = measured(df, text_col, q, clean=True).where(f"{q}_kept").withColumn(text_col, F.col(f"{q}_text"))
    if chars_col in df.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(df.schema[chars_col].dataType))
    return out.select(*df.columns)


_SQL_SPACE, _SQL_WORD = _SPACE.replace("\\\\", "\\"), _WORD.replace("\\\\", "\\")
_SQL_BOILER = _boiler("low", f"len(list_filter(regexp_split_to_array(l, '{_SQL_SPACE}+'), lambda x: x <> ''))", "regexp_matches({0}, '{1}')")

JUDGE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SQL_SPACE}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_SQL_WORD}')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(w[i : i + {REPEAT_WINDOW - 1}], ' ') AS s
        FROM (SELECT rid, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) AS i FROM a)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range({REPEAT_WINDOW})) AS o) GROUP BY rid),
l AS (SELECT rid, l, translate(l, '{_UPPER}', '{_LOWER}') AS low FROM (SELECT rid, unnest(lines) AS l FROM a)),
judged AS (SELECT rid, length(l) AS c, {_SQL_BOILER} AS boiler, (length(l) - length(replace(l, '|', '')) >= 2
    OR 10 * (length(l) - length(translate(l, '{_SYMBOLS}', ''))) > length(l)
    OR (NOT regexp_matches(l, '[a-z]') AND regexp_matches(l, '[A-Z]') AND regexp_matches(l, '{_SQL_WORD}{_SQL_SPACE}+{_SQL_WORD}+{_SQL_SPACE}+{_SQL_WORD}'))
    OR NOT regexp_matches(l, '[.!?…]([\\s\\x0b"”»)]|$)')) AS fails FROM l),
loss AS (SELECT rid, sum(c) AS line_chars, coalesce(sum(c) FILTER (fails), 0) AS lost_chars, coalesce(sum(c) FILTER (fails OR boiler), 0) AS removed_chars FROM judged GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{_SQL_SPACE}', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '{_SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars,
             CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars
      FROM a LEFT JOIN rep USING (rid) LEFT JOIN loss USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_chars <= {MAX_LOSS_PERCENT} * line_chars AND 100 * removed_chars <= {MAX_REMOVED_PERCENT} * line_chars AS kept, line_chars, lost_chars, removed_chars FROM b
"""
