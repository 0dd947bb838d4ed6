"""Porter's suffix stripping as DuckDB SQL, to check stemmed search against: one table expression for each step."""

from __future__ import annotations

from tidepool.functions.stemming import STEP2, STEP3, STEP4


def _shape(word: str) -> str:
    """C or V for each letter; a y is a vowel after a consonant, which rounds of replacement settle from left to right."""
    out = f"regexp_replace(regexp_replace(regexp_replace({word}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(4):
        out = f"regexp_replace(regexp_replace({out}, 'Cy', 'CV', 'g'), 'Vy', 'VC', 'g')"
    return out


def _shortened(word: str, by: str) -> str:
    return f"left({word}, length({word}) - {by})"


_M, _CVC = "len(regexp_extract_all(sh, 'V+C+'))", "(regexp_matches(sh, 'CVC$') AND NOT regexp_matches(r, '[wxy]$'))"


def _ends(suffixes) -> str:
    return "(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$"


def _replaced(table: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def stems_sql(words: str) -> str:
    """Table expressions that end in ``stems`` (w, st), for a table expression ``words`` (w) of different terms."""
    steps = []

    def step(source: str, suffix: str, new: str, rest: str = "") -> str:
        """``s`` is the suffix that is looked at, ``r`` the word without it, ``sh`` the shape of that."""
        name = f"p{len(steps)}"
        rest = rest or _shortened("x", "length(s)")
        steps.append(f"{name}_s AS (SELECT w, x, {suffix} AS s FROM {source}), {name}_r AS (SELECT *, {rest} AS r FROM {name}_s), {name}_h AS (SELECT *, {_shape('r')} AS sh FROM {name}_r), {name} AS (SELECT w, {new} AS x FROM {name}_h)")
        return name

    steps.append(f"folded AS (SELECT w, strip_accents(w) AS x FROM {words}), long AS (SELECT * FROM folded WHERE length(x) BETWEEN 3 AND 64)")
    at = step("long", "regexp_extract(x, '(sses|ies|ss|s)$', 1)", "CASE s WHEN 'sses' THEN r || 'ss' WHEN 'ies' THEN r || 'i' WHEN 's' THEN r ELSE x END")
    # 1b: what ends in ed or ing is marked by a star until its end is mended
    at = step(at, "regexp_extract(x, '(eed|ed|ing)$', 1)", f"CASE WHEN s = 'eed' THEN CASE WHEN {_M} > 0 THEN r || 'ee' ELSE x END WHEN s <> '' AND contains(sh, 'V') THEN r || '*' ELSE x END")
    at = step(
        at,
        "CASE WHEN contains(x, '*') THEN '*' ELSE '' END",
        f"""CASE WHEN s = '' THEN x WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e'
            WHEN length(r) > 1 AND right(r, 1) = left(right(r, 2), 1) AND right(sh, 1) = 'C' AND NOT regexp_matches(r, '[lsz]$') THEN {_shortened("r", "1")}
            WHEN {_M} = 1 AND {_CVC} THEN r || 'e' ELSE r END""",
    )
    at = step(at, "regexp_extract(x, '(y)$', 1)", "CASE WHEN s = 'y' AND contains(sh, 'V') THEN r || 'i' ELSE x END")
    for table in (STEP2, STEP3):
        at = step(at, f"regexp_extract(x, '{_ends(table)}', 1)", f"CASE WHEN s <> '' AND {_M} > 0 THEN r || {_replaced(table)} ELSE x END")
    at = step(at, f"regexp_extract(x, '{_ends(STEP4)}', 1)", f"CASE WHEN s <> '' AND {_M} > 1 AND (s <> 'ion' OR regexp_matches(r, '[st]$')) THEN r ELSE x END")
    at = step(at, "regexp_extract(x, '(e)$', 1)", f"CASE WHEN s = 'e' AND ({_M} > 1 OR {_M} = 1 AND NOT {_CVC}) THEN r ELSE x END")
    at = step(at, "CASE WHEN x LIKE '%ll' THEN 'l' ELSE '' END", f"CASE WHEN s = 'l' AND {_M} > 1 THEN r ELSE x END")
    steps.append(f"stems AS (SELECT w, x AS st FROM {at} UNION ALL SELECT w, x FROM folded WHERE NOT length(x) BETWEEN 3 AND 64)")
    return ", ".join(steps)
