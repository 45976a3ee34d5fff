"""Secret scans behind a trigram index, in DataFrame functions only.

Method. Every rule's regex is parsed and a Boolean trigram query derived from it: the strings
that any match must contain, as an OR of ANDs of lower-cased trigrams. The index holds postings
(trigram, document) of the trigrams that the rules ask for; a clause's postings are intersected,
clauses of a rule united, and only the candidate documents are verified with the rule's regex. A
rule with no mandatory trigram scans every document. Texts are shuffled once, to meet their
candidate flags; postings are narrow and summed up before they are shuffled.

Defined cases. A null text is empty and has no span. Repeated rows each keep their result; rows
with a null doc_id are scanned like others. An empty table gives an empty result; extra columns
are carried by redacted() and ignored by scan().
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name, regex, group whose length counts and its least length, in the order of ties.
BASE_RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE_RULES = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 30),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
]
RULES = BASE_RULES + MORE_RULES
#: Strings that a part of a regex may stand for before it counts as open.
STRINGS_MAX = 64
#: Values of a character class before it counts as open.
CLASS_MAX = 5


def _strings(item) -> set[str] | None:
    """Lower-cased strings that one item of a parsed regex stands for; None: too many to tell."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is C.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                found.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < CLASS_MAX:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= CLASS_MAX else None
    if op is C.BRANCH:
        parts = [_sequence(x)[0] for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is C.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _sequence(arg[2])[0]
        return None if inner is None else inner | {""}
    return None


def _sequence(items) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that the items stand for, or None, and the sets of strings of which a match has one each."""
    now, closed, needed = {""}, True, []
    for item in items:
        more = _strings(item)
        if more is not None and len(now) * len(more) <= STRINGS_MAX:
            now = {a + b for a in now for b in more}
        else:
            needed.append(now)
            now, closed = {""}, False
    return (now if closed else None), [*needed, now]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of which a matching text fulfils one, each a set of trigrams; None: no mandatory trigram."""
    best: list[frozenset[str]] | None = None
    for strings in _sequence(_parser.parse(pattern))[1]:
        if all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses = sorted((c for c in sets if not any(d < c for d in sets)), key=sorted)
            if best is None or min(map(len, clauses)) > min(map(len, best)):
                best = clauses
    return best


def _spans(text: Column, order: int, name: str, pattern: str, group: int, least: int) -> Column:
    """(start, kind, name, end) of a rule's matches in code points, end exclusive."""
    hits, sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rest = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,kind:int,name:string,end:int>>")
    zipped = F.arrays_zip(F.slice(rest, 1, F.greatest(F.size(hits), F.lit(0))).alias("r"), hits.alias("h"), sized.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["r"])
        end = start + F.length(x["h"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), F.lit(name).alias("name"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(pattern), folded).otherwise(none)


def candidates(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """(key, rules): bits of the rules whose trigram query the row fulfils; rows(key, text)."""
    clauses = [(r, c) for r, rule in enumerate(rules) for c in trigram_query(rule[1]) or []]
    wanted = sorted({g for _, c in clauses for g in c})
    low = rows.select("key", F.lower("text").alias("low"))
    postings = low.select("key", F.explode(F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in wanted)))).alias("trigram"))
    parts = [(g, i, 1 << k, r) for i, (r, c) in enumerate(clauses) for k, g in enumerate(sorted(c))]
    full = {i: (1 << len(c)) - 1 for i, (_, c) in enumerate(clauses)}
    asked = rows.sparkSession.createDataFrame([(g, i, bit, 1 << r, full[i]) for g, i, bit, r in parts], "trigram string, clause int, bit long, rule long, full long")
    # asked: as long as the rules, whatever the corpus
    met = postings.join(F.broadcast(asked), "trigram").groupBy("key", "clause", "rule", "full").agg(F.bit_or("bit").alias("have"))
    return met.where("have = full").groupBy("key").agg(F.bit_or("rule").alias("rules"))


def _scanned(docs: DataFrame, keep: list[str], rules: list[tuple]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64("doc_id", text).alias("key"), F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"), text.alias("text"))
    flagged = rows.join(candidates(rows.select("key", "text"), rules), "key", "left")
    found = []
    for r, (name, pattern, group, least) in enumerate(rules):
        spans = _spans(F.col("text"), r, name, pattern, group, least)
        if trigram_query(pattern) is not None:
            none = F.array().cast("array<struct<start:int,kind:int,name:string,end:int>>")
            spans = F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0, spans).otherwise(none)
        found.append(spans)
    return flagged.select("row", "text", F.array_sort(F.concat(*found)).alias("spans"))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs(doc_id, text)."""
    s = _scanned(docs, ["doc_id"], RULES).select(F.col("row.doc_id").cast("long").alias("doc_id"), "spans", F.filter("spans", lambda x: x["kind"] < len(BASE_RULES)).alias("base"))
    kinds = F.transform("base", lambda x: x["kind"])
    count = [F.size(F.array_remove(F.array_append(kinds, F.lit(-1)), r)) for r in range(len(BASE_RULES))]
    count = [(F.size("base") + 1 - n).cast("long").alias(f"n_{rule[0]}") for n, rule in zip(count, BASE_RULES, strict=True)]
    return s.select("doc_id", *count, F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret in `text` replaced by mark; overlapping spans become one. Null stays null."""
    others = [c for c in docs.columns]
    s = _scanned(docs, others, RULES)
    text, spans = F.col("text"), F.col("spans")

    def step(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    folded = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size(spans) > 0, folded).otherwise(F.col("row.text"))
    return s.select(*((clean if c == "text" else F.col(f"row.{c}")).alias(c) for c in others))


def _oracle() -> str:
    spans = []
    for r, (name, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        spans.append(f"""
    list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1), lambda i: struct_pack(
        s := CAST(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        k := {r}, n := '{name}',
        e := CAST(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i], lambda x: length(x))) AS BIGINT),
        g := length(regexp_extract_all(t, '{p}', {group})[i]))), lambda m: m.g >= {least})""")
    said = "coalesce(array_to_string(list_transform({}, lambda m: m.n || ':' || m.s || ':' || m.e), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort({" || ".join(spans)}) AS a FROM d),
b AS (SELECT doc_id, a, list_filter(a, lambda m: m.k < {len(BASE_RULES)}) AS base FROM f)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(base, lambda m: m.k = {r})) AS BIGINT) AS n_{rule[0]}" for r, rule in enumerate(BASE_RULES))},
    sha256({said.format("base")}) AS base_sha256, {said.format("a")} AS spans
FROM b"""


ORACLE = _oracle()
