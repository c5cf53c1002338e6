"""Personal data by candidate gradient boosting (operator 5), in DataFrame operations only.

Regular expressions find the base spans of four kinds. Then high-recall generators propose further spans in the text
between them: other spellings of the same kinds, and secrets. Proposals of different kinds overlap. Boosted trees score
them by format and context; a threshold for each kind, calibrated on held-out candidates, selects those that join the base
spans; of overlapping ones the best score stays.

What the trees learn from, in at most SAMPLE_ROWS documents with a digit or an at-sign (a documented bound):
each base span of the sample is put back into its context in other spellings (spaced or bracketed at-signs and dots, other
separators, no plus sign), which are the positives, and as decoys (failing check digits, octets above 255, dates, amounts,
book numbers), which are negatives; so is every candidate of the texts as they stand. Secrets are positives where a value
with many digits and letters is assigned to a name such as token or password. At most SAMPLE_CANDIDATES of them reach the
driver, which fits the trees; they run as SQL expressions over whole texts, so the main path has no Python. Everything
happens within a row: nothing is shuffled, and work grows in proportion to the text, however many spans it has.

Defined results: null counts as empty text; repeated rows give equal results; base spans of different kinds may
overlap and all stay; added spans overlap no base span and no better added span (of equal scores the first, then the kind
listed first); in redacted text, overlapping spans become one mark of the first kind; an empty table gives an empty result,
and a sample without base spans adds none; extra columns stay untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobarn.llm import boosting
from isobarn.llm.common import hash_sample, materialize

#: Kinds in their order within a tie of starts; the first four have base spans.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
SPAN = "array<struct<start:int,kind:int,stop:int>>"
CANDIDATE = "array<struct<start:int,kind:int,stop:int,s:string,before:string,after:string>>"
#: Bounds of the training sample, and the precision that each kind's added spans must have on held-out candidates.
SAMPLE_ROWS = 1500
SAMPLE_CANDIDATES = 8000
PRECISION = 0.98
SAMPLE_PARTS = 16
#: Characters of context before and after a candidate.
CONTEXT, CONTEXT_AFTER = 24, 12
#: Spans whose positions are added up at a time, and code points redacted at a time.
PART, BLOCK = 128, 4096
#: No candidate is longer than 480 code points, so fewer than REACH others start within its reach.
REACH = 640
#: Stands for each code point of a base span where candidates are looked for.
MASK = "\ue000"

_LOCAL = "[A-Za-z0-9._%+-]"
#: Each finds the leftmost non-overlapping matches of its kind that can pass the kind's test, in linear time: a
#: match starts where a run of its characters starts, or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT = r"(?: ?@ ?| ?[(\[]at[)\]] ?| at )"
_POINT = r"(?:\.| ?[(\[](?:\.|dot)[)\]] ?| dot )"
#: High-recall generators, by the kind that an accepted span gets. All their repeats are bounded.
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_POINT}[A-Za-z0-9-]{{1,63}}+){{1,5}}",
    "ip": r"(?=[0-9])(?<![0-9.])[0-9]{1,3}+(?:(?: ?[(\[]?(?:\.|dot)[)\]]? ?)[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?=[0-9])(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?=[0-9(])(?<![0-9])\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,64}+[0-9])(?=[0-9+/_-]{0,64}+[A-Za-z])[A-Za-z0-9+/_-]{16,200}+={0,2}(?![A-Za-z0-9+/_=-])",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "contains(t, '@')", "ip": "contains(t, '.')", "card": "rlike(t, '[0-9]')", "phone": "contains(t, '+')"}
GENERATOR_NEEDS = {
    "email": "(contains(t, '@') OR contains(t, 'at)') OR contains(t, 'at]') OR contains(t, ' at '))",
    "ip": "rlike(t, '[0-9]')", "card": "rlike(t, '[0-9]')", "phone": "rlike(t, '[0-9]')", "secret": "rlike(t, '[0-9]')",
}


def _luhn(digits: str) -> str:
    return (
        f"aggregate(sequence(1, char_length({digits})), 0, (s, i) -> s + if(i % 2 = 1, int(substr(reverse({digits}), i, 1)), "
        f"int(substr(reverse({digits}), i, 1)) * 2 - if(int(substr(reverse({digits}), i, 1)) > 4, 9, 0))) % 10 = 0"
    )


_DIGITS = "regexp_replace(k.m, '[^0-9]', '')"
#: Which match m passes.
TESTS = {
    "email": "true",
    "ip": "forall(split(k.m, '[.]'), p -> coalesce(try_cast(p AS INT), 256) <= 255)",
    "card": f"char_length({_DIGITS}) BETWEEN 12 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"char_length({_DIGITS}) BETWEEN 9 AND 15",
}

_LENGTH = lambda pattern: f"char_length(regexp_replace(c.s, '{pattern}', ''))"
#: Numbers that the trees see of a candidate c with digits d and runs of digits r: its format, and the context around it.
FEATURES = {
    "kind": "c.kind",
    "chars": "c.stop - c.start",
    "digits": "char_length(v.d)",
    "letters": _LENGTH("[^A-Za-z]"),
    "upper": _LENGTH("[^A-Z]"),
    "dots": _LENGTH("[^.]"),
    "spaces": _LENGTH("[^ ]"),
    "dashes": _LENGTH("[^-]"),
    "slashes": _LENGTH("[^/]"),
    "brackets": _LENGTH(r"[^()\\[\\]]"),
    "at": "int(contains(c.s, '@'))",
    "spelled_at": r"int(rlike(c.s, '[(\\[ ]at[)\\] ]'))",
    "spelled_dot": r"int(rlike(c.s, '[(\\[ ]dot[)\\] ]'))",
    "top_domain": "int(rlike(c.s, '[.t) \\\\]][A-Za-z]{2,10}$'))",
    "check_digit": f"if(char_length(v.d) BETWEEN 12 AND 19, int({_luhn('v.d')}), -1)",
    "octets": "int(size(v.r) = 4 AND forall(v.r, x -> coalesce(try_cast(x AS INT), 256) <= 255))",
    "runs": "size(v.r)",
    "first_run": "if(size(v.r) > 0, char_length(v.r[0]), 0)",
    "last_run": "if(size(v.r) > 0, char_length(v.r[size(v.r) - 1]), 0)",
    "longest_run": "coalesce(array_max(transform(v.r, x -> char_length(x))), 0)",
    "year": "int(exists(v.r, x -> rlike(x, '^(19|20)[0-9]{2}$')))",
    "hexadecimal": "int(rlike(c.s, '^[0-9a-fA-F]+$'))",
    "phone_word": "int(rlike(lower(c.before), '(tel|phone|call|fax|mobile)'))",
    "mail_word": "int(rlike(lower(c.before), '(mail|contact|write)'))",
    "card_word": "int(rlike(lower(c.before), '(card|visa|account|payment)'))",
    "host_word": "int(rlike(lower(c.before), '(host|server|address|login)'))",
    "key_word": "int(rlike(lower(c.before), '(token|secret|key|passw|pwd|credential|auth)[a-z_]{0,12}[\"\\']? ?[:=]'))",
    "assigned": "int(rlike(c.before, '[=:] ?.?$'))",
    "quoted": "int(rlike(c.before, '[\"\\']$'))",
    "joined": "int(rlike(c.before, '[A-Za-z0-9/.-]$'))",
    "goes_on": "int(rlike(c.after, '^[.,:/-]?[A-Za-z0-9]'))",
}
_FEATURES = (
    "transform(array(struct(regexp_replace(c.s, '[^0-9]', '') AS d, filter(split(c.s, '[^0-9]+'), x -> x <> '') AS r)), v -> named_struct("
    + ", ".join(f"'{n}', double({e})" for n, e in FEATURES.items())
    + "))[0]"
)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(name: str, value: str, body: str) -> str:
    """SQL of body with value under a name, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _walk(pairs: str, item: str, test: str, kind: str) -> str:
    """SQL: an item of each pair k (gap g, match m) that passes the test; k starts at a.at + char_length(k.g).

    Lengths are added up within parts of PART pairs, and over the parts: no array is copied for each match.
    """
    long = "char_length(k.g) + char_length(k.m)"
    parts = f"transform(sequence(0, (size(ps) - 1) div {PART}), i -> slice(ps, i * {PART} + 1, {PART}))"
    starts = f"aggregate(pt, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, p) -> named_struct('at', a.at + aggregate(p, 0, (n, k) -> n + {long}), 'out', array_append(a.out, a.at)), a -> a.out)"
    inner = f"aggregate(p, named_struct('at', o, 'out', cast(array() AS {kind})), (a, k) -> named_struct('at', a.at + {long}, 'out', if({test}, array_append(a.out, {item}), a.out)), a -> a.out)"
    return _bound("ps", pairs, _bound("pt", parts, f"flatten(zip_with(pt, {starts}, (p, o) -> {inner}))"))


def _found(pattern: str, need: str, otherwise: str, body: str, text: str) -> str:
    """SQL: body over the matches ms of a pattern and what lies between them, gs; `otherwise` where there are none."""
    p = _literal(pattern)
    split = _bound("gs", f"split({text}, {p}, -1)", body)
    return f"if({need.replace('(t,', f'({text},')}, {_bound('ms', f'regexp_extract_all({text}, {p}, 0)', f'if(size(ms) = 0, {otherwise}, {split})')}, {otherwise})"


_PAIRS = "zip_with(slice(gs, 1, size(ms)), ms, (g, m) -> named_struct('g', g, 'm', m))"
_START, _STOP = "a.at + char_length(k.g)", "a.at + char_length(k.g) + char_length(k.m)"


def base_sql() -> str:
    """SQL over text t: base spans by start, then kind."""

    def own(kind: str) -> str:
        span = f"named_struct('start', {_START}, 'kind', {KINDS.index(kind)}, 'stop', {_STOP})"
        return _found(PATTERNS[kind], NEEDS[kind], f"cast(array() AS {SPAN})", _walk(_PAIRS, span, TESTS[kind], SPAN), "t")

    return f"array_sort(concat({', '.join(map(own, BASE_KINDS))}))"


def masked_sql() -> str:
    """SQL over text t: the text with MASK for each code point of its base spans, kind by kind."""
    out = "t"
    for kind in BASE_KINDS:
        piece = f"transform({_PAIRS}, k -> concat(k.g, if({TESTS[kind]}, repeat('{MASK}', char_length(k.m)), k.m)))"
        whole = f"concat(array_join({piece}, ''), element_at(gs, -1))"
        out = _bound("t", out, _found(PATTERNS[kind], NEEDS[kind], "t", whole, "t"))
    return out


def candidate_sql() -> str:
    """SQL over text t: candidates of all generators, those of different kinds overlapping."""

    def own(kind: str) -> str:
        # a pair also knows what follows its match
        pairs = f"transform(ms, (m, i) -> named_struct('g', gs[i], 'm', m, 'n', left(gs[i + 1], {CONTEXT_AFTER})))"
        span = f"named_struct('start', {_START}, 'kind', {KINDS.index(kind)}, 'stop', {_STOP}, 's', k.m, 'before', right(k.g, {CONTEXT}), 'after', k.n)"
        return _found(GENERATORS[kind], GENERATOR_NEEDS[kind], f"cast(array() AS {CANDIDATE})", _walk(pairs, span, "true", CANDIDATE), "t")

    return f"concat({', '.join(map(own, KINDS))})"


#: Values that are taken for secrets while learning: long ones with digits and letters, assigned to a telling name.
_SEED = "c.kind = 4 AND f.key_word = 1 AND f.digits >= 6 AND f.letters >= 4 AND f.chars >= 20"
#: Other spellings and decoys of a base span m with digits d, as (what comes before, text, whether it is personal data).
_CARD = "regexp_replace(%s, '([0-9]{4})(?=[0-9])', '$1%s')"
_WRONG = "concat(left(d, char_length(d) - 1), string((int(right(d, 1)) + 1 + int(substr(d, 2, 1)) % 8) % 10))"
_PHONE = "regexp_replace(right(d, 10), '^([0-9]{3})([0-9]{3})', '%s')"
VARIANTS = {
    "email": [("", f"replace(m, '@', '{a}')", 1) for a in (" @ ", "(at)", " (at) ", "[at]", " [at] ", "@ ")]
    + [("", f"concat(substring_index(m, '@', 1), '{a}', replace(substring_index(m, '@', -1), '.', '{p}'))", 1) for a, p in ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("@", " dot "))]
    + [("", "concat('look at ', substring_index(m, '@', -1))", 0), ("", "concat('2 @ 5.', length(m))", 0), ("", "concat('done at ', length(m), '.30')", 0)],
    "ip": [("", f"replace(m, '.', '{p}')", y) for p in ("[.]", "(.)", " . ", "[dot]", ". ") for y in (1,)]
    + [("", f"replace(concat(300 + char_length(d), '.', substr(m, instr(m, '.') + 1)), '.', '{p}')", 0) for p in (".", "[.]", " . ", ". ")],
    "card": [("", _CARD % ("d", p), 1) for p in ("", " ", "-", ".", "/", "_", "  ", " - ")] + [("", _CARD % (_WRONG, p), 0) for p in ("", ".", "/", " ", "-", "  ")],
    "phone": [("", "substr(m, 2)", 1), ("", "concat('00', substr(m, 2))", 1)]
    + [("", _PHONE % form, 1) for form in ("($1) $2-", "$1-$2-", "$1.$2.", "$1 $2 ", "$1/$2-", "($1)$2-")]
    + [("'tel. '", "d", 1), ("", "d", 0), ("", "right(d, 8)", 0)]
    + [("", f"concat('20', substr(d, 2, 2), '{p}0', 1 + int(substr(d, 4, 1)) % 9, '{p}1', substr(d, 5, 1))", 0) for p in ("-", "/", ".")]
    + [("", f"concat(left(d, 1), '{p}', substr(d, 2, 3), '{p}', substr(d, 5, 3))", 0) for p in (" ", ".")]
    + [("", "concat('978-', left(d, 1), '-', substr(d, 2, 2), '-', substr(d, 4, 6), '-', right(d, 1))", 0), ("", "concat(left(d, 4), ' - ', substr(d, 5, 4))", 0), ("", "concat('1 ', left(d, 1), ' 2 ', substr(d, 3, 2), ' 3 ', right(d, 3))", 0)],
    "secret": [("", "m", 1), ("'api_key: '", "m", 1), ("'\"password\": \"'", "m", 1), ("'SECRET='", "upper(m)", 1), ("'auth-token = '", "replace(m, 'a', '_')", 1)]
    + [(b, "m", 0) for b in ("'commit '", "'id = '", "'/files/'", "'sha1: '", "' '")],
}


def training_candidates(documents: DataFrame, rows: int = SAMPLE_ROWS, candidates: int = SAMPLE_CANDIDATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and halves (0 to fit, 1 to calibrate) of at most `candidates` candidates of at most `rows` documents.

    The halves come from different documents, so that a span's spellings don't appear in both.
    """
    some = documents.select("doc_id", F.col("text").cast("string").alias("t")).where("rlike(t, '[0-9@]')")
    chosen = hash_sample(some, "doc_id", rows).withColumn("half", F.pmod(F.xxhash64("t"), F.lit(2))).repartition(SAMPLE_PARTS)
    chosen = materialize(chosen, "sample")  # a sample comes out of one task, and is used four times
    base = chosen.select("half", "t", F.explode(F.expr(base_sql())).alias("c")).select("half", "t", "c.kind", "c.start", "c.stop")
    place = F.xxhash64("t", "c.start", "c.stop", "c.kind").alias("place")
    plain = chosen.select("half", "t", F.expr(_bound("t", masked_sql(), candidate_sql())).alias("all")).select("half", "t", F.explode("all").alias("c")).withColumn("f", F.expr(_FEATURES))
    secrets = chosen.select("half", "t", F.explode(F.expr(candidate_sql())).alias("c")).withColumn("f", F.expr(_FEATURES)).where(_SEED).select("half", "t", "c.kind", "c.start", "c.stop")
    spans = base.unionByName(secrets).selectExpr("half", "kind", "substr(t, start + 1, stop - start) AS m", "substr(t, greatest(start - 40, 0) + 1, least(start, 40)) AS b", "substr(t, stop + 1, 20) AS e")
    spans = spans.withColumn("d", F.regexp_replace("m", "[^0-9]", "")).where("kind = 4 OR kind < 3 OR char_length(d) >= 11")

    def forms(kind: str) -> str:
        bare = "regexp_replace(b, '[A-Za-z_]*[\"\\']? ?[:=] ?[\"\\']?$', '')" if kind == "secret" else "b"
        return "array(" + ", ".join(f"struct(concat({'b' if not p and kind == 'secret' else bare}, {p or repr('')}) AS b, {v} AS v, {y} AS y)" for p, v, y in VARIANTS[kind]) + ")"

    cases = " ".join(f"WHEN kind = {i} THEN {forms(k)}" for i, k in enumerate(KINDS))
    varied = spans.select("half", "kind", "e", F.explode(F.expr(f"CASE {cases} END")).alias("x")).select("half", F.col("kind").alias("own"), "x.*", F.expr("concat(x.b, x.v, e)").alias("t"))
    made = varied.select("half", "t", "own", "b", "v", "y", F.explode(F.expr(candidate_sql())).alias("c")).withColumn("f", F.expr(_FEATURES)).where("c.stop > char_length(b) AND c.start < char_length(b) + char_length(v)")
    hit = "own = c.kind AND abs(c.start - char_length(b)) <= 1 AND abs(c.stop - char_length(b) - char_length(v)) <= 1"
    found = plain.select("half", "f", place, F.expr(f"int({_SEED})").alias("y")).unionByName(made.select("half", "f", place, F.expr(f"int(y = 1 AND {hit})").alias("y")))
    held = found.orderBy("place", "y").limit(candidates).collect()  # bounded
    x = np.array([list(r["f"]) for r in held], np.float64).reshape(-1, len(FEATURES))
    return x, np.array([r["y"] for r in held], np.float64), np.array([r["half"] for r in held], np.int64)


def selector(documents: DataFrame) -> tuple[str, list[float]]:
    """The trees' log-odds as SQL over fields f.<feature>, and the calibrated threshold of each kind, no less than even odds."""
    x, y, half = training_candidates(documents)
    fit, rest = half == 0, half == 1
    if min(fit.sum(), rest.sum()) < 40 or len(np.unique(y[fit])) < 2:
        return "0D", [float("inf")] * len(KINDS)
    fitted = boosting.fit(x[fit], y[fit], trees=60, depth=4)
    score, kind = boosting.predict(fitted, x[rest]), x[rest][:, list(FEATURES).index("kind")]
    thresholds = [max(0.0, boosting.calibrated_threshold(score[kind == k], y[rest][kind == k], PRECISION)) for k in range(len(KINDS))]
    return boosting.to_sql(fitted, [f"z.f.{name}" for name in FEATURES]), thresholds


def _spans_sql(score: str, thresholds: list[float]) -> str:
    """SQL over t: struct (base, spans): the base spans, and those with the selected candidates."""
    crossed = "exists(zip_with(base, slice(base, 2, size(base)), (p, q) -> coalesce(q.start < p.stop, false)), x -> x)"

    def with_spans(spans: str) -> str:
        return _bound("base", base_sql(), f"named_struct('base', base, 'spans', {spans})")

    if not np.isfinite(thresholds).any():
        return with_spans("base")
    candidates = _bound("t", f"if(size(base) = 0, t, {masked_sql()})", candidate_sql())
    featured = f"transform({candidates}, c -> named_struct('c', c, 'f', {_FEATURES}))"
    scored = f"transform({featured}, z -> named_struct('start', z.c.start, 'kind', z.c.kind, 'stop', z.c.stop, 'score', {score}))"
    least = "array(" + ", ".join(f"{x:.9g}D" if np.isfinite(x) else "double('infinity')" for x in thresholds) + ")"
    # only where base spans overlap each other can a rest of one be in a candidate
    strong = f"array_sort(filter({scored}, z -> z.score >= {least}[z.kind] AND NOT (crossed AND exists(base, b -> b.start < z.stop AND z.start < b.stop))))"
    better = "o.start < z.stop AND z.start < o.stop AND (o.score > z.score OR (o.score = z.score AND (o.start, o.kind, o.stop) < (z.start, z.kind, z.stop)))"
    near = f"slice(st, greatest(i - {REACH}, 0) + 1, {2 * REACH})"
    best = f"transform(filter(st, (z, i) -> NOT exists({near}, o -> {better})), z -> named_struct('start', z.start, 'kind', z.kind, 'stop', z.stop))"
    added = _bound("crossed", crossed, _bound("st", strong, best))
    return with_spans(f"array_sort(concat(base, cast({added} AS {SPAN})))")


def personal_spans(documents: DataFrame, model: tuple[str, list[float]], into: str = "_found") -> DataFrame:
    """The documents with `into`: struct of base and of all spans (start, kind, stop; code points, stop exclusive)."""
    return documents.withColumn(into, F.expr(_bound("t", "coalesce(string(text), '')", _spans_sql(*model))))


def spans_text(spans: str) -> Column:
    """kind:start:stop of the spans in a column, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', array({kinds})[s.kind], string(s.start), string(s.stop))), ',')")


def redact(documents: DataFrame, model: tuple[str, list[float]]) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows the text where it exists.

    Texts are rewritten in blocks of BLOCK code points, each with the spans that reach into it.
    """
    name = "_found"
    while name in documents.columns:
        name += "_"
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    step = f"""(a, s) -> named_struct('at', greatest(a.at, s.stop), 'out', concat(a.out, if(s.start > a.at, substr(b, a.at - o + 1, s.start - a.at), ''),
        if(s.start >= a.at AND s.start >= o, array({kinds})[s.kind], '')))"""
    block = f"aggregate(filter(f.spans, s -> s.start < o + {BLOCK} AND s.stop > o), named_struct('at', o, 'out', ''), {step}, a -> concat(a.out, substr(b, a.at - o + 1)))"
    pieces = f"array_join(transform(regexp_extract_all(x, '(?s).{{1,{BLOCK}}}', 0), (b, i) -> {_bound('o', f'i * {BLOCK}', block)}), '')"
    new = f"transform(array(struct({name} AS f, string(text) AS x)), v -> {pieces.replace('f.spans', 'v.f.spans').replace('_all(x,', '_all(v.x,')})[0]"
    found = personal_spans(documents, model, name)
    out = found.withColumn("text", F.when(F.size(f"{name}.spans") > 0, F.expr(new)).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(f"{name}.spans") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
