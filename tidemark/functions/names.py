"""Canonical names of models, providers, agents, workspaces, speeds and tasks, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Spellings of providers, and what each stands for.
PROVIDERS = {
    "x_ai": "xai", "z_ai": "zai", "moonshot": "moonshotai", "kimi_for_coding": "moonshotai", "meta": "meta_llama", "azure": "azure_ai",
    "vertex": "anthropic", "vertex_ai": "anthropic", "together": "together_ai", "fireworks": "fireworks_ai", "gemini": "google",
    "openai_codex": "openai", "minimaxai": "minimax", "minimax_ai": "minimax", "mistral": "mistralai", "deepseek_ai": "deepseek",
    "novita_ai": "novita", "stepfun_ai": "stepfun",
}
# Model families, in the order in which they are asked, and their vendors.
VENDORS = [
    ("claude|anthropic|opus|sonnet|haiku|fable", "anthropic"), ("gpt|openai|(^|[^a-z0-9])o[134]([^a-z0-9]|$)", "openai"), ("gemini|google", "google"), ("grok", "xai"),
    ("deepseek", "deepseek"), ("minimax", "minimax"), ("mistral|mixtral", "mistral"), ("llama|(^|[^a-z])meta", "meta"), ("qwen", "qwen"), ("fugu", "sakana"),
    ("kimi|(^|[^a-z0-9])k[23]([^a-z0-9]|$)", "moonshotai"), ("mimo", "xiaomi"), ("glm", "zai"),
]
# Speeds by client, and words for the kinds of task.
SPEEDS = {"claude": {"standard": "standard", "fast": "fast"}, "codex": {"default": "standard", "fast": "fast", "priority": "fast", "ultrafast": "ultrafast"}}
TASKS = {
    "feature": "feature", "feat": "feature", "bugfix": "bugfix", "bug": "bugfix", "fix": "bugfix", "refactor": "refactor", "refactoring": "refactor",
    "research": "research", "explore": "research", "investigation": "research", "debug": "debug", "debugging": "debug", "review": "review",
    "code review": "review", "docs": "docs", "documentation": "docs", "config": "config", "configuration": "config", "setup": "config",
}
# Ids and providers of the gateway, marks in agent names.
GATEWAY_MODEL = r"^(hf:|accounts/fireworks/|accounts/together/)"
GATEWAY_PROVIDERS = ["synthetic", "glhf", "synthetic.new", "octofriend"]
AGENT_PREFIX = "^(?i)(astrape:|oh-my-claudecode:|oh-my-codex:)"
ACRONYMS = ["ui", "ux", "api"]


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's value, null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def strip_prefix(model: Column, prefixes: list[str]) -> Column:
    """Without the longest prefix that leaves something, once, whatever its case."""
    known = sorted({p.lower() for p in prefixes if p}, key=lambda p: (-len(p), p))
    return F.regexp_replace(model, f"(?is)^(?:{'|'.join(map(re.escape, known))})(.+)$", "$1") if known else model


def canonical_model(model: Column, prefixes: list[str] | None = None) -> Column:
    """Lower case, without configured prefix, tier in brackets and date; claude-4-6-opus becomes claude-opus-4-6."""
    plain = strip_prefix(F.lower(F.trim(model)), prefixes or [])
    plain = F.regexp_replace(plain, r"\([^()]*\)$", "")
    plain = F.regexp_replace(plain, r"-[0-9]{8}$", "")
    plain = F.regexp_replace(plain, "^anthropic/(claude-.+)$", "$1")
    return F.regexp_replace(plain, "^claude-([0-9]+)-([0-9]+)-(opus|sonnet|haiku)$", "claude-$3-$1-$2")


def alias_key(name: Column) -> Column:
    """What two spellings of a model have in common: case and separators do not count."""
    return F.replace(F.lower(F.trim(name)), F.lit("."), F.lit("-"))


def canonical_provider(raw: Column) -> Column:
    """The provider's usual name; null for nothing, placeholders in angle brackets and fragments of model names, which have digits."""
    name = F.replace(F.regexp_replace(F.lower(F.trim(raw)), "/+$", ""), F.lit("-"), F.lit("_"))
    kept = F.when((name == "") | (name == "unknown") | name.rlike("^<.*>$"), None).when(name == "ai21", name)
    return kept.when(mapped(name, PROVIDERS).isNotNull(), mapped(name, PROVIDERS)).when(name.rlike("[0-9]"), None).otherwise(name)


def inferred_provider(model: Column) -> Column:
    """The vendor of the model's family; a routing prefix of a local server says nothing."""
    name = F.regexp_replace(F.lower(model), "^(ollama/)+", "")
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, vendor in VENDORS:
        found = found.when(name.rlike(family), vendor)
    return found


def resolved_provider(explicit: Column, model: Column, fallback: str = "unknown") -> Column:
    return F.coalesce(canonical_provider(explicit), inferred_provider(model), F.lit(fallback))


def is_gateway(client: Column, model: Column, provider: Column) -> Column:
    """Whether a row went through the gateway: by client, model id or provider."""
    return (F.lower(client) == "synthetic") | F.lower(model).rlike(GATEWAY_MODEL) | F.lower(provider).isin(GATEWAY_PROVIDERS)


def gateway_model(model: Column) -> Column:
    """A gateway's model id without its host and organisation."""
    return F.regexp_replace(F.regexp_replace(F.lower(model), "^hf:(?:[^/]*/)?(.*)$", "$1"), "^accounts/.*?/models/(.*)$", "$1")


# Agents of one family with the roles that may stand behind their names, and names that stand for another.
AGENT_ROLES = {"Sisyphus": ["ultraworker"], "Hephaestus": ["deep agent"], "Prometheus": ["plan builder"], "Atlas": ["plan executor"], "Metis": ["plan consultant"], "Momus": ["plan critic"]}
AGENT_NAMES = {"prometheus (planner)": "Prometheus", "momus (plan reviewer)": "Momus", "orchestrator-sisyphus": "Atlas", "sisyphus-junior": "Sisyphus-Junior", "planner-sisyphus": "Planner-Sisyphus"}
PLANNER, WORKER, COPILOT = "Planner-Sisyphus", "Sisyphus", "GitHub Copilot"


def _plain_agent(agent: Column) -> Column:
    """Without invisible marks and known prefixes, its words one space apart."""
    plain = F.trim(F.regexp_replace(agent, r"[\u200B\u200C\u200D\uFEFF]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, AGENT_PREFIX, ""), r"\s+", " "))


def _titled(name: Column) -> Column:
    """Its words, between hyphens and spaces, with a capital; some are all capitals."""
    words = F.filter(F.split(name, r"[-\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000)))), " ")


def agent_name(agent: Column) -> Column:
    """Without invisible marks and known prefixes, its words with a capital; the planners and orchestrators have their own names."""
    plain = _plain_agent(agent)
    low, titled = F.lower(plain), _titled(plain)
    sisyphus = F.contains(low, F.lit("omo")) | F.contains(low, F.lit("sisyphus"))
    return F.when(F.contains(low, F.lit("plan")) & sisyphus, PLANNER).when(F.contains(low, F.lit("plan")), titled).when(low.isin("omo", "sisyphus"), WORKER).when(low == "orchestrator-sisyphus", "Atlas").otherwise(titled)


def family_agent_name(agent: Column) -> Column:
    """As agent_name, but for a family of agents whose names may have their role behind them, in brackets, after a hyphen or a space."""
    table = dict(AGENT_NAMES)
    for name, roles in AGENT_ROLES.items():
        table[name.lower()] = name
        for role in roles:
            table |= {f"{name.lower()}{between}": name for between in (f" ({role})", f" - {role}", f" {role}")}
    return F.coalesce(mapped(F.lower(_plain_agent(agent)), table), agent_name(agent))


def copilot_agent_name(agent: Column) -> Column:
    """Names below github.copilot, and plugins as `Team: Name`; others as agent_name."""
    low = F.lower(agent)
    rest = F.substring(agent, len("plugin:") + 1, 1_000)
    team = F.substring_index(rest, ":", 1)
    slug = F.substr(rest, F.length(team) + 2)
    plugin = F.when(F.contains(rest, F.lit(":")), F.concat(_titled(team), F.lit(": "), _titled(slug))).otherwise(_titled(rest))
    below = _titled(F.replace(F.substring(agent, len("github.copilot.") + 1, 1_000), F.lit("."), F.lit("-")))
    return F.when(low == "github.copilot.default", COPILOT).when(F.startswith(low, F.lit("github.copilot.")), below).when(F.startswith(low, F.lit("plugin:")), plugin).otherwise(agent_name(agent))


def workspace_key(path: Column) -> Column:
    """A path with forward slashes and no doubled or trailing ones; null for none. A worktree folder counts as its repository."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+", "/"), "(.)/$", "$1")
    root = F.regexp_replace(plain, r"/\.?worktrees/.*$", "")
    return F.when(root != "", root)


def workspace_label(path: Column) -> Column:
    """The last part of the key."""
    return F.element_at(F.split(workspace_key(path), "/"), -1)


def speed(client: str, raw: Column) -> Column:
    """The speed that a client's word names; null where unknown, which is never standard."""
    return mapped(raw, SPEEDS[client])


def task_category(text: Column) -> Column:
    return F.coalesce(mapped(F.lower(text), TASKS), F.lit("other"))


def case_sql(value: str, table: dict[str, str], otherwise: str = "null") -> str:
    """The same look-up in SQL."""
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {otherwise} end"
