"""Scalar rules over codes, versions, prompts and answers."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from passagery import constants as K
from passagery.functions.text import is_blank, null_if_blank, trim_control


def lookup(mapping: Mapping, key: Column, default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(""))), default)


def role_level(code: Column) -> Column:
    """0 is the highest level; unknown codes have none."""
    return lookup({name: level for level, name in K.ROLES}, code, F.lit(K.UNKNOWN_LEVEL))


def can_grant(operator: Column, granted: Column) -> Column:
    """A super user grants anything known; a tenant administrator nothing above itself; others nothing."""
    known = role_level(granted) < K.UNKNOWN_LEVEL
    tenant_admin = (operator == "TENANT_ADMIN") & (role_level(granted) >= role_level(F.lit("TENANT_ADMIN")))
    return known & ((operator == "SUPER_ADMIN") | tenant_admin)


def embedding_family(model: Column) -> Column:
    name = F.upper(F.coalesce(model, F.lit("")))
    openai = name.contains("TEXT-EMBEDDING") | name.contains("OPENAI") | name.contains("ADA")
    return F.when(name.contains("BGE"), "bge-m3").when(openai, "openai").otherwise("tongyi")


def collection_name(tenant_id: Column, kb_id: Column) -> Column:
    return F.concat(F.lit("T"), tenant_id.cast("string"), F.lit("_Kb"), kb_id.cast("string"))


def version_parts(version: Column) -> Column:
    """`vX.Y.Z` as three integers; missing minor or patch is 0, anything unreadable is 1.0.0."""
    parts = F.split(F.regexp_replace(version, "^v", ""), "\\.", -1)
    major, minor, patch = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))

    def number(part: Column) -> Column:
        return F.when(part.isNull(), F.lit(0)).when(part.rlike("^[+-]?[0-9]+$"), part.try_cast("int"))

    ok = major.isNotNull() & number(major).isNotNull() & number(minor).isNotNull() & number(patch).isNotNull()
    good = F.struct(number(major).alias("major"), number(minor).alias("minor"), number(patch).alias("patch"))
    base = F.struct(F.lit(1).alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("patch"))
    return F.when(ok, good).otherwise(base)


def format_version(major: Column, minor: Column, patch: Column) -> Column:
    return F.format_string("v%d.%d.%d", major, minor, patch)


def next_version(latest: Column, change_type: Column) -> Column:
    part = version_parts(latest)
    zero = F.lit(0)
    return (
        F.when(latest.isNull(), F.lit("v1.0.0"))
        .when(change_type == "MAJOR", format_version(part["major"] + 1, zero, zero))
        .when(change_type == "PATCH", format_version(part["major"], part["minor"], part["patch"] + 1))
        .otherwise(format_version(part["major"], part["minor"] + 1, zero))
    )


def document_facet(status: Column) -> Column:
    state = F.upper(F.coalesce(status, F.lit("")))
    return (
        F.when(state.isin("", "COMPLETED"), "INDEXED").when(state == K.FAILED, "FAILED").otherwise("PROCESSING")
    )


def parse_json_list(text: Column, element: str = "string") -> Column:
    """JSON array text as an array; null, empty or unreadable text is an empty array."""
    kind = f"array<{element}>"
    return F.coalesce(F.from_json(text, kind, {"mode": "PERMISSIVE"}), F.array().cast(kind))


def params_snapshot(mode: Column, params: Mapping | None = None) -> Column:
    """The chunking parameters in force, as JSON."""
    given = dict(params or {})
    flat = {
        "delimiter": given.get("delimiter", K.TEXT_DELIMITER),
        "maxTokens": given.get("max_tokens", K.TEXT_MAX),
        "chunkOverlap": given.get("overlap", K.TEXT_OVERLAP),
    }
    nested = {
        "parentSeparator": given.get("parent_sep", K.PARENT_SEP),
        "parentMaxTokens": given.get("parent_max", K.PARENT_MAX),
        "childSeparator": given.get("child_sep", K.CHILD_SEP),
        "childMaxTokens": given.get("child_max", K.CHILD_MAX),
        "parentMode": K.PARENT_MODE,
    }
    as_json = lambda d: F.lit(json.dumps(d, ensure_ascii=False, separators=(",", ":")))
    return F.when(mode == K.HIERARCHICAL_MODEL, as_json(nested)).otherwise(as_json(flat))


def normalize_strategy(name: Column) -> Column:
    """Both spellings of the hierarchical strategy; everything else is the text model."""
    code = F.lower(F.regexp_replace(trim_control(F.coalesce(name, F.lit(""))), "-", "_"))
    return F.when(code == K.HIERARCHICAL_MODEL, K.HIERARCHICAL_MODEL).otherwise(K.TEXT_MODEL)


def check_input(text: Column, sensitive: list[str] | None = None) -> Column:
    """True when the text is safe to process."""
    lowered = F.lower(text)
    bad = F.lit(False)
    for phrase in K.INJECTION_PHRASES:
        bad = bad | lowered.contains(phrase)
    for word in sensitive or []:
        bad = bad | text.contains(word)
    return is_blank(text) | ~bad


def check_output(text: Column, sensitive: list[str] | None = None) -> Column:
    bad = F.lit(False)
    for word in sensitive or []:
        bad = bad | text.contains(word)
    return is_blank(text) | ~bad


def accept_rewrite(query: Column, rewritten: Column) -> Column:
    """A blank or more than fivefold longer rewrite is refused."""
    text = trim_control(rewritten)
    refuse = is_blank(rewritten) | (F.length(text) > F.length(query) * 5)
    return F.when(refuse, query).otherwise(text)


def is_generic(verdict: Column) -> Column:
    first = F.substring(trim_control(F.coalesce(verdict, F.lit(""))), 1, 1)
    return first.isin("是", "Y", "y")


def route_generic(enabled: Column, kb_id: Column, query: Column, verdict: Column) -> Column:
    return enabled & kb_id.isNotNull() & check_input(query) & is_generic(verdict)


def tag_answer(tag: Column, answer: Column) -> Column:
    return F.when(is_blank(tag), answer).otherwise(F.concat(tag, F.lit("\n"), answer))


def build_prompt(query: Column, context: Column) -> Column:
    full = F.concat(F.lit(K.CONTEXT_HEAD), context, F.lit(K.QUESTION_HEAD), query)
    return F.when(is_blank(context), query).otherwise(full)


def resolve_prompt(is_rag: Column, kb_prompt: Column, global_prompt: Column, default: Column, chat: Column) -> Column:
    rag = F.coalesce(null_if_blank(kb_prompt), null_if_blank(global_prompt), default)
    return F.when(is_rag, rag).otherwise(null_if_blank(chat))


def route_answer(is_rag: Column, context: Column, generated: Column) -> Column:
    return F.when(is_rag & is_blank(context), F.lit(K.NO_ANSWER)).otherwise(generated)


def fallback_answer(citations: Column) -> Column:
    """An answer made of the cited snippets alone."""
    lines = F.transform(
        citations,
        lambda c: F.concat(
            F.lit("["), c["index"].cast("string"), F.lit("] "), F.coalesce(c["snippet"], F.lit("")), F.lit("\n\n")
        ),
    )
    body = F.concat(F.lit(K.FALLBACK_HEAD), F.array_join(lines, ""))
    return F.when(F.coalesce(F.size(citations), F.lit(0)) <= 0, F.lit(K.FALLBACK_EMPTY)).otherwise(body)


def fill_template(template: Column, query: Column) -> Column:
    return F.replace(template, F.lit("{query}"), F.coalesce(query, F.lit("")))


def normalize_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(key, F.lit("")), "[_-]", ""))


def session_title(first_user_text: Column) -> Column:
    return F.substring(trim_control(null_if_blank(first_user_text)), 1, K.TITLE_CHARS)


def citation_label(chunk_id: Column) -> Column:
    """The short form a citation shows of its chunk: the last eight characters of the id."""
    return F.concat(F.lit("#"), F.right(chunk_id, F.lit(8)))
