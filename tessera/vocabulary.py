"""Closed vocabularies: enumerations and the attribute keys of each domain."""

from __future__ import annotations

# The literals that records may hold.
STAGES = ("expand", "search", "merge", "dedup", "store", "rank")
PROGRESS_PHASES = ("start", "done")
FEEDBACK_KINDS = ("like", "dislike")
DEDUP_DECISIONS = ("auto_merge", "tiebreak", "insert_new")
SEARCH_ENGINES = ("frontier_native", "exa", "linkup", "perplexity", "serper")
AUTH_SCHEMES = ("telegram", "api_token", "local")
RUN_MODES = ("live", "eval")

# Attribute keys by domain, each with the sign shown before it.
ATTRIBUTES: dict[str, dict[str, str]] = {
    "events": {"organizer": "🏛️", "tags": "🎵", "program": "🎤", "ticket_availability": "🎟️"},
    "papers": {"authors": "✍️", "published_in": "📚", "doi": "🔖", "institution": "🏫", "code_url": "💻", "topics": "🏷️"},
    "jobs": {"company": "🏢", "salary": "💰", "employment_type": "📋", "remote_policy": "🏠", "seniority": "📈"},
    "real_estate": {"property_type": "🏠", "listing_type": "🏷️", "bedrooms": "🛏️", "bathrooms": "🛁", "area": "📐", "agent": "🧑‍💼"},
    "products": {"brand": "🏷️", "retailer": "🛒", "original_price": "💵", "discount": "🔻", "rating": "⭐", "availability": "📦"},
    "vehicles": {"make_model": "🚗", "model_year": "📅", "mileage": "🛣️", "fuel_type": "⛽", "transmission": "⚙️", "seller_type": "🧑‍💼"},
    "grants": {"funder": "🏛️", "award_amount": "💰", "deadline": "⏳", "eligibility": "✅", "field": "🔬"},
    "software_releases": {"project": "📦", "version": "🏷️", "language": "💻", "license": "📜", "changelog_url": "📝"},
    "travel": {"origin": "🛫", "destination": "🛬", "carrier": "✈️", "trip_type": "🔁", "cabin_class": "💺"},
}
FALLBACK_DOMAIN = "events"

# Names of the structured calls a language model answers with.
CALLS = {
    "expand": "submit_queries",
    "classify": "submit_domain",
    "judge": "submit_verdicts",
    "rerank": "submit_ranking",
    "search": "submit_search_results",
    "builder": "submit_draft",
}


def keys_of(domain: str | None) -> tuple[str, ...]:
    return tuple(ATTRIBUTES.get(domain or "", {}))


def signs_of(domain: str | None) -> dict[str, str]:
    return dict(ATTRIBUTES.get(domain or "", {}))


def describe(key: str) -> str:
    """What a model is told to put under a key."""
    return f"the {key.replace('_', ' ')}, if the page states it"


def call_schema(name: str, properties: dict, required: list[str]) -> dict:
    """The description of a structured call; extra properties are forbidden."""
    return {"type": "function", "name": name, "parameters": {"type": "object", "properties": properties, "required": required, "additionalProperties": False}}


def search_call(domain: str | None) -> dict:
    """The search call with ``attributes`` narrowed to the domain's keys."""
    attributes = {"type": "object", "properties": {k: {"type": "string", "description": describe(k)} for k in keys_of(domain)}, "additionalProperties": False}
    row = {"type": "object", "properties": {"url": {"type": "string"}, "title": {"type": "string"}, "attributes": attributes}}
    return call_schema(CALLS["search"], {"results": {"type": "array", "items": row}}, ["results"])


def _listed(name: str, field: str, row: dict, required: list[str]) -> dict:
    item = {"type": "object", "properties": row, "required": required, "additionalProperties": False}
    return call_schema(CALLS[name], {field: {"type": "array", "items": item}}, [field])


def call_of(stage: str, domain: str | None = None) -> dict:
    """The structured call that a stage's model answers with."""
    text, number, flag = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
    if stage == "search":
        return search_call(domain)
    if stage == "expand":
        return _listed(stage, "queries", {"language": text, "query": text}, ["language", "query"])
    if stage == "classify":
        return call_schema(CALLS[stage], {"domain": {"type": "string", "enum": list(ATTRIBUTES)}}, ["domain"])
    if stage == "judge":
        return _listed(stage, "verdicts", {"pair": number, "same": flag}, ["pair", "same"])
    if stage == "rerank":
        return _listed(stage, "ranking", {"id": number, "why": text}, ["id"])
    if stage == "builder":
        draft = {"message": text, "ready": flag, "text": text, "city": text, "schedule_cron": text, "schedule_text": text, "max_results_shown": number}
        return call_schema(CALLS[stage], draft, ["message", "ready"])
    raise ValueError(f"no stage {stage} with a structured call")
