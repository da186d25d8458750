"""Recipes that come with the engine, over tables of pages. Pages are read as they are; fetching them is not this engine's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.markup import frames as M
from harrow.markup import read

# What an audit reads of a page, field by field.
SEO_FIELDS = {
    "title": "title", "meta_description": "meta[name='description'] | content", "canonical": "link[rel='canonical'] | href", "h1": "h1",
    "og_title": "meta[property='og:title'] | content", "og_description": "meta[property='og:description'] | content", "og_image": "meta[property='og:image'] | content",
    "og_type": "meta[property='og:type'] | content", "twitter_card": "meta[name='twitter:card'] | content", "robots": "meta[name='robots'] | content",
    "viewport": "meta[name='viewport'] | content", "charset": "meta[charset] | charset",
}


def seo_page_audit(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, and a text for each of ``SEO_FIELDS``): the first match on the page, null without one.

    A page that leaves out its root element has one all the same.
    """
    whole = F.when(F.col(html).rlike(r"(?i)<html[\s>]"), F.col(html)).otherwise(F.concat(F.lit("<html>"), html))
    found = M.with_items(pages.select(key, whole.alias(html)), "html", SEO_FIELDS, html, "__found").select(key, F.get("__found", F.lit(0)).alias("__found"))
    return found.select(key, *[F.when(F.col(f"__found.{f}") != "", F.col(f"__found.{f}")).alias(f) for f in SEO_FIELDS])


def news_article(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, title, byline, published, site_name, content): the article of every page, nulls where there is none."""
    return M.with_article(pages.select(key, html), html, False, "__article").select(key, "__article.*")


def extracted(df: DataFrame, text: str, model: Callable[[list[str]], list[str]], schema: str, out: str = "extracted", most: int = 100_000) -> DataFrame:
    """``df`` with what a caller's model answers: a struct of value (``schema``), error and truncated.

    ``model`` takes a batch's texts, cut to ``most`` characters, and gives an answer for each; the JSON in an answer is
    recovered and read by ``schema``. A batch that fails is asked again text by text, so that one text costs no other its
    answer: its error is kept instead. Null texts are not asked.
    """
    from harrow.markup.frames import each_batch

    def answers(texts: list[str | None]) -> list[dict | None]:
        asked = [x[:most] for x in texts if x is not None]
        try:
            got = [(a, None) for a in model(asked)] if asked else []
            if len(got) != len(asked):
                raise ValueError("the model gave another number of answers")
        except Exception:  # noqa: BLE001
            got = [_one(model, x) for x in asked]
        rest = iter(got)
        return [None if x is None else _row(*next(rest), len(x) > most) for x in texts]

    kind = T.StructType().add("json", "string").add("error", "string").add("truncated", "boolean")
    made = each_batch(df, text, kind, answers, "__answer")
    a = F.col("__answer")
    shown = F.struct(F.from_json(a["json"], schema).alias("value"), a["error"].alias("error"), a["truncated"].alias("truncated"))
    return made.withColumn(out, F.when(a.isNotNull(), shown)).drop("__answer")


def _one(model: Callable, text: str) -> tuple[str | None, str | None]:
    try:
        return model([text])[0], None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"


def _row(answer: str | None, error: str | None, cut: bool) -> dict:
    json = None if answer is None else read.recovered_json(answer)
    return {"json": json, "error": error or (None if json is not None else "no JSON in the answer"), "truncated": cut}
