"""Dictionary matching: which terms texts hold, aliases in running text, and fields named by aliases.

A dictionary is an Aho-Corasick automaton that reads a text once, whatever the
number of terms.  A worker builds it from a block of terms; a larger dictionary
has several blocks, each of which the texts go through.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T

#: Characters of the terms of one block (a hash deals terms to blocks, so this holds on average).
BLOCK = 8 << 20


def _blocks(terms: DataFrame) -> Iterator[list[str]]:
    """The distinct terms (term) in blocks, which come to the driver one at a time."""
    t = terms.select("term").where("term <> ''").distinct()
    size = t.agg(F.sum(F.length("term"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    for b in range(blocks):
        block = [r["term"] for r in t.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect()]
        if block:
            yield block


def _automaton(terms: list[str]):
    import ahocorasick  # an optional dependency, needed in the workers

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def _read(texts: DataFrame, terms: DataFrame, row, schema: K.StructType) -> DataFrame:
    """The rows that row(automaton, text) makes of every text (id, n), with its id, of all blocks together."""
    out = None
    src = texts.select("id", "n").where("n <> ''")
    for block in _blocks(terms):
        sent = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            a = _automaton(sent.value)
            for pdf in batches:
                found = [(i, *r) for i, n in zip(pdf["id"], pdf["n"]) for r in row(a, n)]
                yield pd.DataFrame(found, columns=schema.names)

        part = src.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


def held_terms(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, id): the distinct terms (term) that each text (id, n) holds as a part, wherever they stand, once each.

    Null and empty terms are held by none, and null texts hold none.
    """
    schema = K.StructType([texts.schema["id"], K.StructField("term", K.StringType())])
    return _read(texts, terms, lambda a, n: [(t,) for t in {t for _, t in a.iter(n)}], schema).select("term", "id")


def alias_mentions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, start, size, alias, names): the aliases that texts (id, text) name, the leftmost first and of those the longest, without overlap.

    Both are taken in lower case, with anything but letters and digits as one space;
    an alias is found as whole words.  start is the place among the text's words,
    size the number of words, names the distinct names (aliases: name, alias) that the alias
    stands for, in order.  ids of texts must be unique.  Null and empty aliases and texts match nothing.
    """
    known = aliases.select(T.normalized_key("alias").alias("alias"), "name").where("alias <> '' and name is not null")
    terms = known.select(F.concat(F.lit(" "), "alias", F.lit(" ")).alias("term"))
    n = texts.select("id", F.concat(F.lit(" "), T.normalized_key("text"), F.lit(" ")).alias("n"))

    def row(a, n: str) -> Iterator[tuple[int, int, str]]:
        before, at = 0, 0  # words before the character `at`
        for start, term in sorted((end - len(term) + 1, term) for end, term in a.iter(n)):
            before, at = before + n.count(" ", at, start), start
            yield before, term.count(" ") - 1, term[1:-1]

    schema = K.StructType([texts.schema["id"], K.StructField("start", K.IntegerType()), K.StructField("size", K.IntegerType()), K.StructField("alias", K.StringType())])
    found = _read(n, terms, row, schema).repartition("id").sortWithinPartitions("id", "start", F.desc("size"))

    def leftmost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, end = None, 0  # the text that is being read, and where its last match ended
        for pdf in batches:
            keep = []
            for i, start, size in zip(pdf["id"], pdf["start"], pdf["size"]):
                if i != own:
                    own, end = i, 0
                if ok := start >= end:
                    end = start + size
                keep.append(ok)
            yield pdf[keep]

    names = known.groupBy("alias").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return found.mapInPandas(leftmost, schema).join(names, "alias").select("id", "start", "size", "alias", "names")


def alias_fields(raw: Column, fields: Mapping[str, Sequence[str]]) -> Column:
    """A struct with each field's value in the map raw: that of the first key, in the map's order, which is one of its aliases but for case, spaces and marks; null if none is."""
    compact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    entries = F.map_entries(raw)

    def value(aliases: Sequence[str]) -> Column:
        own = F.array(*(compact(F.lit(a)) for a in aliases))
        return T.squeezed(F.try_element_at(F.filter(entries, lambda e: F.array_contains(own, compact(e["key"]))), F.lit(1))["value"])

    return F.struct(*(F.nullif(value(a), F.lit("")).alias(f) for f, a in fields.items()))
