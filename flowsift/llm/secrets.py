"""Secret scans: a trigram index narrows each rule to candidates, which the rule's pattern verifies.

DataFrame expressions alone. A rule's pattern is Java's, whose engine recurses in a repeated group
unless the repeat is possessive: patterns repeat single signs, or groups possessively, and no sign is
tried from more than one start, so a text of any length takes bounded stack and linear time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.common import fresh, stored


@dataclass(frozen=True)
class Rule:
    """``literals``: alternatives, each a list of strings that all occur (in any case) in a match;
    none where the pattern has no mandatory string of three characters. A match counts when its
    ``group`` has ``least`` characters. ``base`` rules are counted in the report."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    literals: tuple[tuple[str, ...], ...] = ()
    base: bool = False


RULES = (
    # the contract's three, in its order
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, (("password",), ("passwd",), ("secret",), ("token",), ("apikey",), ("api_key",)), True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16, 0, (("akia",),), True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, (), True),
    # added
    Rule("pem", r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]+ )*+PRIVATE KEY-----", 1, 0, (("-----begin ", "private key-----"),)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0, (("ghp_",), ("gho_",), ("ghu_",), ("ghs_",), ("ghr_",))),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0, (("eyj", ".eyj"),)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0, (("xoxa-",), ("xoxb-",), ("xoxp-",), ("xoxr-",), ("xoxs-",))),
)
MASK = "[secret]"


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """The rule's need as an OR of ANDs over lower-case trigrams, without alternatives that another
    implies; empty if the rule has no mandatory trigram and must scan everything."""
    sets = {frozenset().union(*(trigrams(part) for part in parts)) for parts in rule.literals}
    if not sets or frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _key(id_col: str, text: str) -> Column:
    return F.xxhash64(id_col, text)


def postings(docs: DataFrame, id_col: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``(trigram, key)`` of every row and each trigram that any rule's query asks for."""
    wanted = sorted(frozenset().union(*(s for r in rules for s in trigram_query(r))))
    lower = F.lower(F.col(text))
    rows = docs.where(F.col(text).isNotNull()).select(_key(id_col, text).alias("key"), lower.alias("t"))
    found = F.filter(F.array(*(F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in wanted)), lambda g: g.isNotNull())
    return rows.select(F.explode(found).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(key, rules)``: rows whose postings meet a rule's query; rows that meet none are left out.

    Postings are intersected by row, combined before the shuffle, so that of a trigram that most
    rows hold is spread over all tasks.
    """
    own = index.groupBy("key").agg(F.collect_set("trigram").alias("g"))
    asked = [r for r in rules if trigram_query(r)]
    meets = [F.when(reduce(Column.__or__, (F.size(F.array_except(F.array(*map(F.lit, sorted(s))), "g")) == 0 for s in trigram_query(r))), F.lit(r.kind)) for r in asked]
    kinds = F.filter(F.array(*meets), lambda k: k.isNotNull())
    return own.select("key", kinds.alias("rules")).where(F.size("rules") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end, kind>>``, in code points, of a rule's leftmost matches that count."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = found if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("s"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        counts = F.length(x["group"]) >= rule.least
        return F.struct(end.alias("at"), F.when(counts, F.concat(done["s"], F.array(span))).otherwise(done["s"]).alias("s"))

    parts = F.zip_with(found, groups, lambda f, g: F.struct(f.alias("found"), g.alias("group")))
    zipped = F.transform(parts, lambda p, i: F.struct(F.get(gaps, i).alias("gap"), p["found"].alias("found"), p["group"].alias("group")))
    return F.aggregate(zipped, start, step)["s"]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secret_spans") -> DataFrame:
    """All columns of ``docs`` with ``into``, which replaces one of that name: ``array<struct<start, end, kind>>`` by start, then rule.

    Postings of the trigrams that the rules need are intersected to candidates per rule; a rule is
    tried on its candidates only, one without mandatory trigrams on every text. Rows meet their
    candidates by a hash of id and text, so equal rows and null ids are all scanned; a hash that
    two rows share only adds a candidate. Null and empty texts have no spans. No rows give no rows.
    """
    index = stored(postings(docs, id_col, text, rules), "postings")
    docs = docs.drop(into)
    key, kinds = fresh(docs, "_key"), fresh(docs, "_rules")
    chosen = candidates(index, rules).select(F.col("key").alias(key), F.col("rules").alias(kinds))
    rows = docs.withColumn(key, _key(id_col, text)).join(chosen, key, "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    body = F.col(text)
    found = []
    for rule in rules:
        tried = F.array_contains(kinds, rule.kind) if trigram_query(rule) else F.lit(True)
        found.append(F.when(tried & F.rlike(body, F.lit(rule.pattern)), matches(body, rule)).otherwise(none))
    place = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))))
    ordered = F.array_sort(F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.withColumn(into, F.coalesce(spans, none)).drop(key, kinds)


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        new = F.concat(done["parts"], F.array(gap, F.lit(MASK)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when((s["start"] >= done["at"]), new).otherwise(done["parts"]).alias("parts"))

    done = F.aggregate(spans, start, step)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["parts"], ""), rest))


def report(scanned: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds and digests of spans."""
    base = [r.kind for r in rules if r.base]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("secret_spans", lambda s: s["kind"].isin(base))
    return scanned.select(
        F.col(id_col).alias("doc_id"), *map(of, base),
        F.sha2(F.array_join(F.transform(own, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", line), ",").alias("spans"),
    )
