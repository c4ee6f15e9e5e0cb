"""Reading generated answers, stock answers where there are none, prompts, and the place where a generator is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.schemas import GENERATED

_OPTIONS = {"mode": "PERMISSIVE"}


def parsed(response: Column) -> Column:
    """The answer's object as a struct; null where there is no readable object."""
    return F.from_json(T.json_object(T.without_thinking(response)), GENERATED, _OPTIONS)


def questions(response: Column, most: Column) -> Column:
    """ARRAY<STRUCT<text, keywords, difficulty>>: nested lists flattened, cut at ``most`` before empty ones go."""

    def of(answer: Column) -> Column:
        own = answer["questions"]
        listed = F.when(F.get(own, F.lit(0))["questions"].isNotNull(), F.get(own, F.lit(0))["questions"]).otherwise(F.transform(own, lambda q: q.dropFields("questions")))
        named = F.transform(F.slice(listed, F.lit(1), most), lambda q: F.struct(T.strip(F.coalesce(F.nullif(q["text"], F.lit("")), q["question"])).alias("text"), F.coalesce(q["keywords"], F.array().cast("array<string>")).alias("keywords"), F.coalesce(q["difficulty"], F.lit("medium")).alias("difficulty")))
        return F.coalesce(F.filter(named, lambda q: F.coalesce(q["text"], F.lit("")) != ""), F.array().cast("array<struct<text:string,keywords:array<string>,difficulty:string>>"))

    return T.let(parsed(response), of)


def vocabulary(response: Column) -> Column:
    """ARRAY<STRUCT<word, definition, example>> of the entries that have a word and a meaning."""
    own = F.filter(parsed(response)["vocabulary"], lambda v: v["word"].isNotNull() & v["definition"].isNotNull())
    return F.coalesce(F.transform(own, lambda v: F.struct(T.strip(v["word"]).alias("word"), T.strip(v["definition"]).alias("definition"), T.strip(F.coalesce(v["example"], F.lit(""))).alias("example"))), F.array().cast("array<struct<word:string,definition:string,example:string>>"))


def tags(response: Column) -> Column:
    return F.coalesce(F.filter(F.transform(parsed(response)["tags"], T.strip), lambda t: F.coalesce(t, F.lit("")) != ""), F.array().cast("array<string>"))


#: Stock questions about a chapter, with keywords and difficulty.
STOCK_QUESTIONS = [
    ("Why do you think the events in '{}' happened the way they did?", ["reason", "cause", "because", "event"], "medium"),
    ("How did the characters in '{}' change or grow?", ["change", "character", "development", "growth"], "medium"),
    ("What lesson or message do you think '{}' is trying to teach?", ["lesson", "message", "theme", "moral"], "medium"),
    ("How would you feel if you were in the situation described in '{}'?", ["feeling", "emotion", "situation", "experience"], "easy"),
    ("Why is '{}' important to the overall story?", ["important", "significance", "story", "plot"], "medium"),
]


def stock_questions(title: Column, n: Column) -> Column:
    """The first n stock questions about a title."""
    rows = [F.struct(F.replace(F.lit(q), F.lit("{}"), title).alias("text"), F.array(*map(F.lit, k)).alias("keywords"), F.lit(d).alias("difficulty")) for q, k, d in STOCK_QUESTIONS]
    return F.slice(F.array(*rows), F.lit(1), n)


def prompt(template: Column | str, values: dict[str, Column]) -> Column:
    """Fills named places of a template."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompt_text(text: Column, most: int = 2000) -> Column:
    """The first ``most`` words with three dots; shorter texts as they are."""
    return T.let(T.words(text), lambda w: F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("..."))).otherwise(text))


def page_fallback(n_pages: Column) -> Column:
    """What to do with pages where no analysis came: drop the first two and last two, of books of more than 20 pages."""
    many = n_pages > 20
    back = F.when(many & (n_pages > 2), F.array(n_pages - 1, n_pages)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.array_union(F.array(F.lit(1), F.lit(2)), back).alias("delete_pages"), F.lit(3).alias("content_start_page"), F.when(many, n_pages - 2).otherwise(n_pages).alias("content_end_page"))


def answered(prompts: DataFrame, provider: Callable[[list[str]], list[str]], id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """(id, response) from any provider that answers a list of prompts; called on each Arrow batch in the workers."""
    id_type = prompts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "response": provider(rows["prompt"].tolist())})

    return prompts.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt")).mapInPandas(run, f"id {id_type}, response string")
