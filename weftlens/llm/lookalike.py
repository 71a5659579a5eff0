"""Visually identical texts to one consistent form (problem 7).

A vocabulary of canonical spellings is held in a trie; a weighted edit
automaton walks it along the characters of each token as they are written,
look-alikes and ignorable characters at no cost, other edits at one each, and
the spelling that it ends at is the canonical one. Tokens that the vocabulary
doesn't know are normalised by table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlens.functions.columns import set_aside
from weftlens.functions.visual import shape_of, visual_form
from weftlens.session import cut

_TOKEN = re.compile(r"[0-9 !-/:-@\[-`{-~]+|[^0-9 !-/:-@\[-`{-~]+")


# Letters that look like several Latin ones, and the further ones besides that of the table.
SEVERAL = {"ӏ": "I", "Ӏ": "l", "І": "l", "Ι": "l", "Ь": "b", "ո": "u", "ս": "ll", "ш": "w", "п": "n", "г": "r"}


@lru_cache(maxsize=65536)
def readings(ch: str, several: bool = False) -> tuple[str, ...]:
    """What one character may be read as at no cost, each as decomposed characters: its shape, itself, and if asked for the others that it looks like; '' if nothing is drawn."""
    if " " <= ch <= "~":
        return (ch,)
    if not shape_of(ch):
        return ("",)
    return tuple(dict.fromkeys([unicodedata.normalize("NFD", shape_of(ch)), unicodedata.normalize("NFD", ch), *([SEVERAL[ch]] if several and ch in SEVERAL else [])]))


class SpellingTrie:
    """Canonical spellings, decomposed, with their frequencies; ``several`` lets the letters that look like several others be each of them."""

    def __init__(self, spellings: dict[str, int], several: bool = False):
        self.root: dict = {}
        self.several = several
        for spelling, n in spellings.items():
            node = self.root
            for ch in unicodedata.normalize("NFD", spelling):
                node = node.setdefault(ch, {})
            node[""] = (spelling, n)

    def best(self, token: str, budget: int = 0) -> str | None:
        """The canonical spelling at least cost within ``budget``, else None.

        The automaton reads the token as it is written. A character moves along
        every edge path that it may be read as, at no cost; one that isn't drawn
        stays where it is. Any other edge costs one, as do a character left out
        and one put in. On ties the shape by the table goes first, then the more
        frequent spelling, then the smaller one.
        """
        states = self._insertions({id(self.root): (0, self.root)}, budget)
        # Marks of one letter in canonical order, composed letters left as they are.
        for ch in unicodedata.normalize("NFD", token) if not unicodedata.is_normalized("NFC", token) else token:
            moved: dict[int, tuple[int, dict]] = {}
            forms = readings(ch, self.several)
            for cost, node in states.values():
                for form in forms:
                    below = self._along(node, form)
                    if below is not None:
                        self._keep(moved, below, cost, budget)
                if cost < budget:
                    for edge, below in node.items():
                        if edge:
                            self._keep(moved, below, cost + 1, budget)
                    self._keep(moved, node, cost + 1, budget)
            states = self._insertions(moved, budget)
            if not states:
                return None
        ends = [(cost, node[""]) for cost, node in states.values() if "" in node]
        if not ends:
            return None
        shape = visual_form(token)
        return min(ends, key=lambda e: (e[0], e[1][0] != shape, -e[1][1], e[1][0]))[1][0]

    @staticmethod
    def _along(node: dict, form: str) -> dict | None:
        for ch in form:
            node = node.get(ch)
            if node is None:
                return None
        return node

    @staticmethod
    def _keep(states: dict, node: dict, cost: int, budget: int) -> None:
        if cost <= budget and (id(node) not in states or cost < states[id(node)][0]):
            states[id(node)] = (cost, node)

    def _insertions(self, states: dict, budget: int) -> dict:
        todo = list(states.values()) if budget else []
        while todo:
            cost, node = todo.pop()
            for edge, below in node.items():
                if edge and cost < budget and (id(below) not in states or cost + 1 < states[id(below)][0]):
                    states[id(below)] = (cost + 1, below)
                    todo.append((cost + 1, below))
        return states


def vocabulary(texts: DataFrame, text: str, most: int = 20_000) -> dict[str, int]:
    """The ``most`` frequent tokens that are written in their canonical form already, with their counts.

    Counted over all rows; only the result, bounded by ``most``, comes to the
    driver. Tokens beyond it are normalised by table, to the same form.
    """
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, int] = {}
            for t in batch[text]:
                if t is not None and not t.isascii():
                    for token in _TOKEN.findall(t):
                        if not token.isascii() and visual_form(token) == token:
                            seen[token] = seen.get(token, 0) + 1
                elif t is not None:
                    for token in _TOKEN.findall(t):
                        if token[0].isalpha():
                            seen[token] = seen.get(token, 0) + 1
            yield pd.DataFrame({"token": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    counts = texts.select(text).mapInPandas(split, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counts.orderBy(F.desc("n"), "token").limit(most).collect()}


def canonical_texts(texts: DataFrame, text: str, spellings: dict[str, int], out: str = "canonical", budget: int = 0, several: bool = False) -> DataFrame:
    """``texts`` with ``out``: every token replaced by its canonical spelling.

    Null stays null, '' stays ''. Printable ASCII is never changed where
    ``budget`` is 0. With ``several``, a letter that looks like several others
    is read as the one that makes a known spelling: the vocabulary's bound then
    counts, as it does with a ``budget``; without either, tokens beyond it come
    to the same form by table. Whole texts, in Arrow batches; tokens are looked
    up once a batch. A column that is called ``out`` already gets ``_in`` after its name.
    """
    texts, name = set_aside(texts, [out])
    text = name(text)
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(spellings)
    schema = T.StructType([*texts.schema.fields, T.StructField(out, T.StringType())])
    tries: dict[str, SpellingTrie] = {}

    def canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = tries.setdefault("trie", SpellingTrie(shared.value, several))
        known: dict[str, str] = {}

        def spell(token: str) -> str:
            if token.isascii() and not budget:
                return token
            if token not in known:
                found = trie.best(token, budget)
                known[token] = found if found is not None else visual_form(token)
            return known[token]

        def whole(t: str | None) -> str | None:
            if t is None or (t.isascii() and not budget):
                return t
            # An accent may stand at the start of a token of its own: compose once more as a whole.
            return unicodedata.normalize("NFC", "".join(spell(token) for token in _TOKEN.findall(t)))

        for batch in batches:
            if len(known) > 200_000:
                known.clear()
            yield batch.assign(**{out: batch[text].astype(object).where(batch[text].notna(), None).map(whole).astype(object)})

    return texts.mapInPandas(canonical, schema)


def alike_pairs(rows: DataFrame, spellings: dict[str, int]) -> DataFrame:
    """(scope, field_name, id_a, id_b) of rows (scope, field_name, id, text) whose texts differ but read the same, id_a < id_b.

    Null texts and null scopes pair with nothing; rows with equal characters
    aren't a pair. Only groups that hold two different spellings are joined,
    spelling by spelling; rows are expanded at the end.
    """
    keyed = canonical_texts(rows.filter("text is not null and scope is not null"), "text", spellings)
    key = ["scope", "field_name", "canonical"]
    # Spellings of a group meet, not its rows: a text that is written one way by very many rows is one spelling.
    written = keyed.select(*key, "text").distinct()
    mixed = written.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    some = cut(written.join(mixed, key, "left_semi"))
    spelled = some.withColumnRenamed("text", "text_a").join(some.withColumnRenamed("text", "text_b"), key).filter("text_a < text_b").select("scope", "field_name", "text_a", "text_b")
    one = rows.select("scope", "field_name", F.col("id").alias("x"), F.col("text").alias("text_a"))
    other = rows.select("scope", "field_name", F.col("id").alias("y"), F.col("text").alias("text_b"))
    pairs = spelled.join(one, ["scope", "field_name", "text_a"]).join(other, ["scope", "field_name", "text_b"]).filter("x <> y")
    return pairs.select("scope", "field_name", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
