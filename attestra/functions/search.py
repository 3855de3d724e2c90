"""Search queries made of what is known of a product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def search_queries(title: Column, parsed: Column, page_colour: Column, vision: dict[str, Column], partial_codes: Column, most: int = 6) -> Column:
    """array<string>: up to most queries from title, page colour, what images show and partial codes, distinct but for case.

    parsed: the title's struct of models.with_titles. vision: brand, model, sub_model, colour, release_names (array). Null or empty parts give no query; white space is squeezed.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    asks = lambda known, *parts: F.when(known, F.concat_ws(" ", *parts))
    t, code = text(title), F.lit("style code")
    brand, model, sub, colour = (text(vision[k]) for k in ("brand", "model", "sub_model", "colour"))
    seen = (brand != "") & (model != "")
    none = F.array().cast("array<string>")

    def single(parsed: Column) -> Column:
        return F.array(
            asks(t != "", t, code),
            asks((t != "") & (parsed["model"] != ""), parsed["model"], parsed["colorway_text"], code),
            asks((t != "") & (text(page_colour) != ""), t, text(page_colour)),
            asks(seen, brand, model, colour, code),
            asks(seen & (sub != ""), brand, model, sub, colour),
        )

    names = F.when(seen, F.transform(F.slice(vision["release_names"], 1, 2), lambda n: F.concat_ws(" ", n, code)))
    every = F.concat(let(parsed, single), F.coalesce(names, none), F.coalesce(F.slice(partial_codes, 1, 3), none))
    clean = F.filter(F.transform(every, lambda q: F.trim(F.regexp_replace(q, r"\s+", " "))), lambda q: q.isNotNull() & (q != ""))
    once = lambda qs: let(F.transform(qs, lambda q: F.lower(q)), lambda low: F.filter(qs, lambda q, i: F.array_position(low, F.lower(q)) == i + 1))
    return F.slice(let(clean, once), 1, most)
