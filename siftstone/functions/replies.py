"""What model services answer, as JSON text: the reply's own text and the tokens it used. Built on variants, a row at a time in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _count(response: Column, path: str) -> Column:
    """A number of the response as a long; what is no number, or isn't there, is 0."""
    v = F.try_variant_get(response, path, "variant")
    return F.when(_kind(v).rlike(NUMBERS), F.coalesce(F.try_variant_get(v, "$", "double").cast("long"), F.lit(0))).otherwise(F.lit(0).cast("long"))


def token_usage(response: Column, shape: Column) -> Column:
    """struct(input_tokens, output_tokens, cache_read_tokens, cache_write_tokens) of a response's JSON text.

    shape: ``messages`` counts uncached input apart; ``chat`` and ``responses`` count what was read from a cache as input
    too, so it is taken off. Any other shape, and a response without usage, has zeros.
    """
    r = F.try_parse_json(response)
    zero = F.lit(0).cast("long")

    def part(messages: str | None, chat: tuple[str, ...] | None, responses: tuple[str, ...] | None) -> Column:
        less = lambda paths: F.greatest(_count(r, paths[0]) - (_count(r, paths[1]) if len(paths) > 1 else zero), zero)
        out = F.when(shape == "messages", _count(r, messages)) if messages else F.when(F.lit(False), zero)
        if chat:
            out = out.when(shape == "chat", less(chat))
        if responses:
            out = out.when(shape == "responses", less(responses))
        return out.otherwise(zero)

    return F.struct(
        part("$.usage.input_tokens", ("$.usage.prompt_tokens", "$.usage.prompt_tokens_details.cached_tokens"), ("$.usage.input_tokens", "$.usage.input_tokens_details.cached_tokens")).alias("input_tokens"),
        part("$.usage.output_tokens", ("$.usage.completion_tokens",), ("$.usage.output_tokens",)).alias("output_tokens"),
        part("$.usage.cache_read_input_tokens", ("$.usage.prompt_tokens_details.cached_tokens",), ("$.usage.input_tokens_details.cached_tokens",)).alias("cache_read_tokens"),
        part("$.usage.cache_creation_input_tokens", None, None).alias("cache_write_tokens"),
    )


def _blocks(content: Column) -> Column:
    """The texts of a content: itself, or those of its blocks put end to end."""
    items = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit(""))
    return F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string")).when(_kind(content).startswith("ARRAY"), F.array_join(F.transform(items, text), "")).otherwise("")


def reply_text(response: Column, shape: Column) -> Column:
    """The text of a response. shape: ``messages`` (content blocks), ``chat`` (the first choice's message) or ``envelope`` (``result``, else the output as it is)."""
    r = F.try_parse_json(response)
    result = F.try_variant_get(r, "$.result", "string")
    plain = F.regexp_replace(response, r"(?U)^\s+|\s+$", "")
    envelope = F.when(_kind(r).startswith("OBJECT"), F.coalesce(result, plain)).otherwise(plain)
    chat = _blocks(F.try_variant_get(r, "$.choices[0].message.content", "variant"))
    return F.when(shape == "messages", _blocks(F.try_variant_get(r, "$.content", "variant"))).when(shape == "chat", chat).otherwise(envelope)


def env_pairs(text: Column) -> Column:
    """KEY=VALUE lines of a settings file as array<struct<key, value>>: comments and lines without ``=`` are left out, ``export`` and one layer of quotes dropped; the last of a key counts."""
    from siftstone.functions.text import once, strip

    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(strip(x), r"^export\s+", ""))
    kept = F.filter(lines, lambda x: ~x.startswith("#") & x.contains("=") & (strip(F.substring_index(x, "=", 1)) != ""))

    def pair(x: Column) -> Column:
        value = strip(F.regexp_replace(x, r"(?s)^[^=]*=", ""))
        bare = F.regexp_replace(value, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2")
        return F.struct(strip(F.substring_index(x, "=", 1)).alias("key"), bare.alias("value"))

    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return once(F.transform(kept, pair), last)
