"""Texts that recorded calls were made with, and what a request to a provider needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import display_name, fill_template, not_blank, strip

#: Fixed value: the prompt of a diagnostic call, whose text is part of what was recorded.
SOURCE_ONLY = "Use ONLY the source text below to answer. Do not use any outside knowledge.\n\nSource page:\n{source_text}\n\nQuestion:\n{question}\n"
#: Fixed value: completion tokens of every request.
COMPLETION_TOKENS = 8192


def institution_header(institution: Column, country: Column, layer: Column) -> Column:
    """A head line and a blank one; empty without an institution."""
    line = F.concat(F.lit("Institution: "), institution, F.lit(" ("), F.coalesce(country, F.lit("")), F.lit(", "), F.coalesce(layer, F.lit("")), F.lit(" level)\n\n"))
    return F.when(F.coalesce(institution, F.lit("")) != "", line).otherwise("")


def context_name(institution: Column, city: Column, everywhere: str = "", suffix: str = "") -> Column:
    """Whom a question is about: one name for all rows, else the row's institution, else its city's name with the
    suffix if there is one. Null counts as empty."""
    if everywhere:
        return F.lit(everywhere)
    base = display_name(city)
    named = F.when(base != "", F.concat(base, F.lit(f", {suffix.strip()}"))).otherwise("") if suffix.strip() else base
    return F.coalesce(not_blank(strip(institution)), named)


def question_prompt(context: Column, question: Column) -> Column:
    about = F.when(context != "", F.concat(F.lit("This question is about "), context, F.lit(".")))
    return F.concat_ws("\n\n", about, F.coalesce(question, F.lit("")), F.lit("(Select all that apply)"))


def source_prompt(source_text: Column, question: Column) -> Column:
    return fill_template(SOURCE_ONLY, source_text=source_text, question=question)


def chosen_models(registry: dict[str, str], names: list[str] | None = None, providers: list[str] | None = None) -> dict[str, str]:
    """The models of ``registry`` (name to id) with exactly these names, else of these providers (the part of the id
    before the slash, in any case), else all. A name or set of providers that matches nothing raises."""
    if names:
        if unknown := [n for n in names if n not in registry]:
            raise ValueError(f"unknown models: {unknown}")
        return {n: i for n, i in registry.items() if n in names}
    if providers:
        wanted = {p.strip().lower() for p in providers}
        found = {n: i for n, i in registry.items() if "/" in i and i.lower().split("/", 1)[0] in wanted}
        if not found:
            raise ValueError(f"no models of {sorted(wanted)}")
        return found
    return dict(registry)


def ordered_schema(schema: dict) -> dict:
    """A JSON schema for providers that want the order of properties named, and know neither additional properties
    nor enumerated numbers. The given schema stays as it is."""
    numeric = schema.get("type") == "number"
    out = {k: v for k, v in schema.items() if k != "additionalProperties" and not (numeric and k == "enum")}
    if out.get("properties"):
        out["properties"] = {k: ordered_schema(v) for k, v in out["properties"].items()}
        out["propertyOrdering"] = [*out["properties"]]
    if isinstance(out.get("items"), dict):
        out["items"] = ordered_schema(out["items"])
    return out
