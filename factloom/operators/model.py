"""Enrichment by an external model: context, prompt, cached responses, calls with retry, and validation."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import registry
from factloom.functions.text import normalize_co2
from factloom.functions.units import canonical_unit, to_canonical_value
from factloom.session import bounded, exists, small, written

RESPONSE = "cache_key string, value double, unit string, reporting_year int, source_snippet string, confidence double"
SYSTEM_PROMPT = "Return the value of the indicator for the latest year as reported for the whole group, with a unit of the given list, or nothing if it isn't reported."
# Providers, their default model, if any, and least seconds between calls.
PROVIDERS = {"anthropic": (None, 0.0), "gemini": ("gemini-2.0-flash", 6.5)}


@dataclass(frozen=True)
class Provider:
    """Where calls go: provider, model and throttle."""

    name: str
    model: str
    interval: float

    @classmethod
    def resolve(cls, name: str | None = None, model: str | None = None) -> Provider:
        """The provider named, or that of LLM_PROVIDER, or the first; an unknown one is an error."""
        chosen = (name or os.environ.get("LLM_PROVIDER") or "anthropic").lower()
        if chosen not in PROVIDERS:
            raise ValueError(f"unknown provider {chosen!r}")
        default, interval = PROVIDERS[chosen]
        named = model or os.environ.get(f"{chosen.upper()}_MODEL") or default
        if not named:
            raise ValueError(f"name a model of {chosen}")
        return cls(chosen, named, interval)


def context(pages: DataFrame, tables: DataFrame, ranking: DataFrame) -> DataFrame:
    """(report_id, kpi, context, retrieved_pages): text of the first 16 pages of a ranking in order, then their tables.

    Of a page 4,000 characters count, as the prompt has a bounded size. Pages without
    text and tables without page are left out.
    """
    top = ranking.where(F.col("rank") < registry.MODEL_PAGES)
    page = F.concat(F.lit("=== Page "), F.col("page_num").cast("string"), F.lit(" ===\n"), F.substring(normalize_co2(F.coalesce("text", F.lit(""))), 1, registry.CONTEXT_CHARS), F.lit("\n"))
    texts = top.join(pages.select("report_id", "page_num", "text"), ["report_id", "page_num"]).groupBy("report_id", "kpi").agg(F.array_sort(F.collect_list(F.struct("rank", "page_num", page.alias("part")))).alias("p"))
    line = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    body = F.concat(F.array(F.concat(F.lit("[Table @ page "), F.col("page_num").cast("string"), F.lit("]"))), F.array(line(F.col("headers"))), F.transform("rows", line), F.array(F.lit("")))
    on = tables.where("page_num is not null").select("report_id", "page_num", "table_idx", F.array_join(body, "\n").alias("part"))
    listed = on.join(top.select("report_id", "kpi", "page_num").distinct(), ["report_id", "page_num"]).groupBy("report_id", "kpi").agg(F.array_sort(F.collect_list(F.struct("table_idx", "part"))).alias("t"))
    parts = F.concat(F.transform("p", lambda s: s["part"]), F.coalesce(F.transform("t", lambda s: s["part"]), F.array().cast("array<string>")))
    return texts.join(listed, ["report_id", "kpi"], "left").select("report_id", "kpi", F.array_join(parts, "\n").alias("context"), F.transform("p", lambda s: s["page_num"]).alias("retrieved_pages"))


def user_prompt(query: Column, unit_family: Column, passages: Column) -> Column:
    """The prompt of one indicator and its passages."""
    return F.concat(F.lit("KPI to extract: "), query, F.lit("\nAcceptable units: "), F.array_join(unit_family, ", "), F.lit("\n\nDocument excerpts:\n"), passages)


def cache_key(model: str, kpi: Column, system: str, user: Column) -> Column:
    """SHA-256 of model, indicator, system prompt and prompt."""
    return F.sha2(F.concat_ws("|", F.lit(model), kpi, F.lit(system), user), 256)


def ask(requests: DataFrame, call: Callable[[str, str, str], dict | None], interval: float = 0.0, attempts: int = 3, base_delay: float = 1.0, limited_delay: float = 60.0, sleep: Callable[[float], None] = time.sleep, lanes: int = 1) -> DataFrame:
    """Responses (RESPONSE) to `requests` (cache_key, kpi, system, user); a failed one has none.

    `call(kpi, system, user)` gives a dict or None; None isn't tried again, an error is, up
    to `attempts` times, after `limited_delay` if its text says 429 or RESOURCE_EXHAUSTED.
    The requests are shared out to `lanes` tasks, each of which keeps `lanes` times
    `interval` seconds between its calls, so a provider's rate holds over all of them.
    """
    own_interval = interval * lanes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = -own_interval
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                answer = None
                for attempt in range(attempts):
                    wait = own_interval - (time.monotonic() - last)
                    if own_interval and wait > 0:
                        sleep(wait)
                    last = time.monotonic()
                    try:
                        answer = call(r.kpi, r.system, r.user)
                        break
                    except Exception as e:  # noqa: BLE001
                        if attempt + 1 < attempts:
                            sleep(limited_delay if "429" in str(e) or "RESOURCE_EXHAUSTED" in str(e) else base_delay * 2**attempt)
                if answer is not None:
                    rows.append((r.cache_key, *(answer.get(k) for k in ("value", "unit", "reporting_year", "source_snippet", "confidence"))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESPONSE.split(", ")]).astype({"reporting_year": "Int32", "value": "float64", "confidence": "float64"})

    # A shuffle after the prompts are built, so that the few lanes don't build them.
    return requests.select("cache_key", "kpi", "system", "user").repartition(lanes).mapInPandas(run, RESPONSE)


def cached_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The response layer in `folder`, empty if there is none."""
    return spark.read.schema(RESPONSE).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], RESPONSE)


def answered(requests: DataFrame, responses: DataFrame, call: Callable[[str, str, str], dict | None] | None = None, layer: str | None = None, **options: object) -> DataFrame:
    """`requests` with their response columns, from_cache and answered; only those not in `responses` are asked for, equal ones once.

    Fresh responses are written before they are used, into the folder `layer` or the shared
    one, so nothing is asked twice however often the result is read. Of several responses
    to one key the greatest counts.
    """
    names = [c.split()[0] for c in RESPONSE.split(", ")]
    one = responses.groupBy("cache_key").agg(F.max(F.struct(*names[1:])).alias("r")).select("cache_key", "r.*")
    cached = one.withColumn("from_cache", F.lit(True))
    if call is not None:
        fresh = written(ask(requests.dropDuplicates(["cache_key"]).join(one, "cache_key", "left_anti"), call, **options))
        if layer is not None:
            fresh.write.mode("append").parquet(layer)
        cached = cached.unionByName(fresh.withColumn("from_cache", F.lit(False)))
    joined = requests.join(cached, "cache_key", "left")
    return joined.withColumn("answered", F.col("from_cache").isNotNull()).withColumn("from_cache", F.coalesce("from_cache", F.lit(False)))


def validated(answers: DataFrame, kpis: DataFrame, name: str = "llm") -> DataFrame:
    """Facts from answers (company, report_year, kpi and response columns): canonical value, or NULL with the flag that says why.

    No answer: api_error. No value: no flag. No unit: llm_missing_unit. A unit unknown or
    of another kind: unit_unknown. A value beyond the plausible range: out_of_range.
    """
    known = kpis.select("kpi", "canonical_unit", "lo", "hi")
    a = answers.join(small(known), "kpi").withColumn("_v", to_canonical_value(F.col("value"), F.col("unit"), F.col("canonical_unit")))
    reason = (
        F.when(~F.col("answered"), "api_error")
        .when(F.col("value").isNull(), F.lit(None))
        .when(F.col("unit").isNull(), "llm_missing_unit")
        .when(canonical_unit(F.col("unit")).isNull() | F.col("_v").isNull(), "unit_unknown")
        .when(~F.col("_v").between(F.col("lo"), F.col("hi")), "out_of_range")
    )
    a = a.withColumn("_r", reason).withColumn("_ok", F.col("answered") & F.col("value").isNotNull() & F.col("_r").isNull())
    held = lambda c: F.when(F.col("_ok"), c)
    return a.select(
        *[c for c in ("report_id",) if c in answers.columns], "company", "report_year", "kpi", held(F.col("_v")).alias("value"), held(F.col("canonical_unit")).alias("unit"), held(F.col("report_year")).alias("reporting_year"), held(F.col("source_snippet")).alias("source_snippet"), F.lit(None).cast("int").alias("source_page"), held(F.col("confidence")).alias("confidence"), F.lit(name).alias("extractor"), F.when(F.col("_r").isNotNull(), F.array("_r")).otherwise(F.array().cast("array<string>")).alias("flags"), F.lit(None).cast("string").alias("run_tag")
    )


def prompt_log(answers: DataFrame, provider: Provider) -> DataFrame:
    """(path, json): one log entry per request, answered or not."""
    response = F.when(F.col("answered"), F.struct("value", "unit", F.col("reporting_year"), F.col("source_snippet"), F.col("confidence")))
    entry = F.struct("company", "report_year", "kpi", F.lit(provider.name).alias("provider"), F.lit(provider.model).alias("model"), "from_cache", "retrieved_pages", F.col("system").alias("system_prompt"), F.col("user").alias("user_prompt"), response.alias("tool_response"))
    return answers.select(F.format_string("%s_%d_%s.json", "company", "report_year", "kpi").alias("path"), F.to_json(entry, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


# Fixed value: what a model has to return, as a JSON schema.
TOOL = {
    "name": "report_value",
    "description": "Returns the value of the indicator as reported, or nothing.",
    "input_schema": {
        "type": "object",
        "properties": {"value": {"type": ["number", "null"]}, "unit": {"type": ["string", "null"]}, "reporting_year": {"type": ["integer", "null"]}, "source_snippet": {"type": ["string", "null"]}, "confidence": {"type": "number"}},
        "required": ["value", "confidence"],
    },
}


def anthropic_call(client: Callable[[], object], model: str) -> Callable[[str, str, str], dict | None]:
    """Calls through the provider's own client, made by `client` in the task; a reply without a tool call is None."""

    def call(kpi: str, system: str, user: str) -> dict | None:
        reply = client().messages.create(model=model, max_tokens=1024, temperature=0, system=system, tools=[TOOL], tool_choice={"type": "tool", "name": TOOL["name"]}, messages=[{"role": "user", "content": user}])
        return next((dict(part.input) for part in reply.content if part.type == "tool_use"), None)

    return call


def gemini_call(client: Callable[[], object], model: str) -> Callable[[str, str, str], dict | None]:
    """The same for the other provider, which takes the schema without lists of types."""
    properties = {k: {"type": (v["type"] if isinstance(v["type"], str) else v["type"][0]).upper(), "nullable": not isinstance(v["type"], str)} for k, v in TOOL["input_schema"]["properties"].items()}
    declared = {"name": TOOL["name"], "description": TOOL["description"], "parameters": {"type": "OBJECT", "properties": properties, "required": ["confidence"]}}

    def call(kpi: str, system: str, user: str) -> dict | None:
        settings = {"temperature": 0, "system_instruction": system, "tools": [{"function_declarations": [declared]}], "tool_config": {"function_calling_config": {"mode": "ANY"}}}
        reply = client().models.generate_content(model=model, contents=user, config=settings)
        return next((dict(c.args) for c in reply.function_calls or []), None)

    return call


def requests(reports: DataFrame, passages: DataFrame, kpis: DataFrame, model: str) -> DataFrame:
    """One request per report and indicator: report_id, company, report_year, kpi, retrieved_pages, system, user and cache_key; a report without pages is asked about with an empty context."""
    every = reports.select("report_id", "company", "report_year").join(bounded(kpis.select("kpi", "query", "unit_family"), "the list of indicators"))
    asked = every.join(passages, ["report_id", "kpi"], "left").withColumn("user", user_prompt(F.col("query"), F.col("unit_family"), F.coalesce("context", F.lit(""))))
    asked = asked.withColumn("system", F.lit(SYSTEM_PROMPT)).withColumn("cache_key", cache_key(model, F.col("kpi"), SYSTEM_PROMPT, F.col("user")))
    return asked.select("report_id", "company", "report_year", "kpi", F.coalesce("retrieved_pages", F.array().cast("array<int>")).alias("retrieved_pages"), "system", "user", "cache_key")


def replay(recorded: dict[str, dict]) -> Callable[[str, str, str], dict | None]:
    """A client that answers by indicator from `recorded` and calls nothing."""
    held = json.dumps(recorded)
    return lambda kpi, system, user: json.loads(held).get(kpi)
