"""Checks for candidate ticket texts: structure, bound evidence, read-only search commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.fixed_values import (
    FENCE,
    INDEX_SOURCE,
    MAX_QUERY_CHARS,
    MAX_TICKET_CHARS,
    READ_ONLY_COMMANDS,
    RISKY_COMMANDS,
    SECTION_TITLES,
)
from flowsift.functions import fmt
from flowsift.functions.bind import let
from flowsift.functions.text import body_lines, count_of, strip

BOUND_MARK, STRAY_MARK = "\u0001", "\u0002"


# ---- response texts ---------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _block_text(block: Column) -> Column:
    nested = F.try_variant_get(block, "$.text", "variant")
    return F.when(_kind(block) == "STRING", _string(block)).when(
        _kind(block).startswith("OBJECT"), _string(nested)
    )


def _content_text(content: Column) -> Column:
    """Text of a message body that is a string or a list of text blocks; null when blank."""
    blocks = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: strip(_block_text(b)))
    joined = F.array_join(F.filter(blocks, lambda t: t.isNotNull() & (t != "")), "\n")
    text = F.when(_kind(content) == "STRING", strip(_string(content))).when(
        _kind(content).startswith("ARRAY"), joined
    )
    return F.nullif(text, F.lit(""))


def extract(df: DataFrame, response: str, out: str = "candidate") -> DataFrame:
    """Adds the ticket text found in JSON responses: the last message with text, else
    ``output``, ``text`` or ``content``."""
    v = F.col("_v")
    messages = F.try_variant_get(v, "$.messages", "array<variant>")
    texts = F.transform(messages, lambda m: _content_text(F.try_variant_get(m, "$.content", "variant")))
    keys = [_content_text(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("output", "text", "content")]
    text = F.when(_kind(v) == "STRING", F.nullif(strip(_string(v)), F.lit(""))).when(
        _kind(v).startswith("OBJECT"), F.coalesce(F.try_element_at("_spoken", F.lit(-1)), *keys)
    )
    parsed = df.withColumn("_v", F.try_parse_json(F.col(response)))
    spoken = F.filter(texts, lambda t: t.isNotNull())
    return parsed.withColumn("_spoken", spoken).withColumn(out, text).drop("_v", "_spoken")


# ---- search queries ---------------------------------------------------------------------------


def query_is_safe(query: Column, source_ip: Column) -> Column:
    """One index, no OR/NOT, bound to the source, read-only commands only."""
    segments = F.split(query, r"\|", -1)
    quoted = lambda ip: F.concat(F.lit('"'), ip, F.lit('"'))

    def base_is_safe(base: Column) -> Column:
        # The address is put in as a mark first, so one constant pattern serves every row.
        marked = F.replace(
            F.replace(F.lower(base), F.lit(BOUND_MARK), F.lit(STRAY_MARK)),
            quoted(F.lower(source_ip)),
            quoted(F.lit(BOUND_MARK)),
        )
        bound = marked.rlike(rf'\bsrc_ip\s*=\s*"{BOUND_MARK}"(?=\s|\z)')
        return (
            base.rlike(INDEX_SOURCE)
            & ~base.rlike(r"(?i)\b(?:OR|NOT)\b")
            & ((source_ip == "unknown") | bound)
        )

    commands = F.transform(
        F.slice(segments, 2, MAX_QUERY_CHARS),
        lambda s: F.lower(F.regexp_extract(s, r"\A\s*([A-Za-z][A-Za-z0-9_-]*)\b", 1)),
    )
    allowed = lambda c: c.isin(READ_ONLY_COMMANDS) & ~c.isin(RISKY_COMMANDS)
    return (
        (strip(query) != "")
        & (F.length(query) <= MAX_QUERY_CHARS)
        & ~query.rlike(r"[`$\[\];]")
        & let(strip(F.get(segments, F.lit(0))), base_is_safe)
        & F.forall(commands, allowed)
    )


def fences_are_safe(ticket: Column, source_ip: Column) -> Column:
    queries = F.regexp_extract_all(ticket, F.lit(FENCE), F.lit(1))
    return (
        (F.size(queries) > 0)
        & (count_of(ticket, "```") == 2 * F.size(queries))
        & F.forall(queries, lambda q: query_is_safe(q, source_ip))
    )


# ---- whole tickets ----------------------------------------------------------------------------


def _section(ticket: Column, index: int) -> Column:
    """Trimmed lines of a section; empty when its heading line carries anything but marks."""
    title, following = SECTION_TITLES[index], SECTION_TITLES[index + 1]
    pattern = rf"(?:\A|\n)[ #*]*\Q{title}\E[ #*]*\n([\s\S]*?)(?<=\n)[^\n]*\Q{following}\E"
    return body_lines(F.regexp_extract(ticket, pattern, 1))


def leaks_attribution(ticket: Column, shap_values: Column) -> Column:
    """True when any raw attribution number is printed, in full or to twelve digits."""
    usable = F.filter(
        shap_values,
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & ~v.isin(0.0, 1.0, -1.0),
    )
    literals = F.concat(
        F.transform(usable, lambda v: fmt.general(v, 12)), F.transform(usable, fmt.shortest)
    )
    standing_alone = lambda text: F.regexp_like(
        ticket, F.concat(F.lit(r"(?<![\d.])\Q"), text, F.lit(r"\E(?![\d.])"))
    )
    found = lambda text: ticket.contains(text) & standing_alone(text)  # a pattern only on a hit
    return F.coalesce(F.exists(F.coalesce(literals, F.array().cast("array<string>")), found), F.lit(False))


def check(
    df: DataFrame,
    candidate: str,
    rendered: str,
    source_ip: str,
    shap_values: Column,
    out: str = "reject_reason",
) -> DataFrame:
    """Adds the first failed check of each candidate, null for an acceptable one.

    ``rendered`` is the deterministic ticket, whose classification and evidence bodies the
    candidate must repeat. Where ``df`` has them as columns, as :func:`ticket_text.render` gives them,
    they aren't cut out of the ticket again.
    """
    ticket = F.col("_ticket")
    starts = [F.get("_starts", F.lit(i)) for i in range(len(SECTION_TITLES))]
    present = ordered = once = F.lit(True)
    for left, right in zip(starts, starts[1:]):
        ordered = ordered & (left < right)
    for title, start in zip(SECTION_TITLES, starts):
        present = present & (start > 0)
        once = once & (F.position(F.lit(title), ticket, start + 1) == 0)
    bodies = {1: f"{rendered}_classification", 2: f"{rendered}_evidence"}
    bound = lambda i: body_lines(F.col(bodies[i])) if bodies[i] in df.columns else _section(F.col(rendered), i)
    same = lambda i: _section(ticket, i) == bound(i)
    structure = (
        F.when(ticket.isNull() | (ticket == ""), F.lit("empty"))
        .when(F.length(ticket) > MAX_TICKET_CHARS, F.lit("too_long"))
        .when(~present, F.lit("missing_section"))
        .when(~starts[0].isin(1, 3, 4), F.lit("text_before_ticket"))
        .when(~ordered, F.lit("section_order"))
        .when(~once, F.lit("repeated_section"))
    )
    safe_queries = F.coalesce(fences_are_safe(ticket, F.col(source_ip)), F.lit(False))
    reason = (
        F.when(F.col("_structure").isNotNull(), F.col("_structure"))
        .when(~safe_queries, F.lit("unsafe_query"))
        .when(~same(1), F.lit("changed_classification"))
        .when(~same(2), F.lit("changed_evidence"))
        .when(ticket.rlike(r"(?i)\bshap[_ ]?value\b"), F.lit("attribution_word"))
        .when(leaks_attribution(ticket, shap_values), F.lit("attribution_value"))
    )
    found = F.array(*[F.instr(ticket, title) for title in SECTION_TITLES])
    prepared = df.withColumn("_ticket", strip(F.col(candidate))).withColumn("_starts", found)
    prepared = prepared.withColumn("_structure", structure)
    return prepared.withColumn(out, reason).drop("_ticket", "_starts", "_structure")


def resolve(candidate: Column, reason: Column, rendered: Column) -> Column:
    """The candidate where it passed, the deterministic ticket everywhere else."""
    return F.when(candidate.isNotNull() & reason.isNull(), candidate).otherwise(rendered)
