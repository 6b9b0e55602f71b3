"""Full-text search: X07 vector, X08 query, X09 match, X10 cover-density rank.

The ``simple`` configuration: tokens are lower-cased runs of letters, digits
and marks; nothing is stemmed and no word is left out. Positions count from 1.
Unlike the full PostgreSQL parser, host names, e-mail addresses, file paths and
signed numbers are not kept together as one token, and all weights are equal.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

TOKEN = r"[\p{L}\p{N}\p{M}]+"
POSITION_LIMIT = 16383  # positions beyond are stored as this one
#: Weight of every lexeme in the rank (class D).
WEIGHT = 0.1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def to_vector(text: Column) -> Column:
    """Map of lexeme to its increasing positions: one sort, then a slice for each run of a lexeme."""
    let = lambda value, body: F.transform(F.array(value), body)[0]
    placed = F.array_sort(F.transform(tokens(text), lambda w, i: F.struct(w.alias("w"), F.least(i + 1, F.lit(POSITION_LIMIT)).alias("p"))))

    def runs(p: Column) -> Column:
        at = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (x["w"] != p[F.greatest(i - 1, F.lit(0))]["w"]), i)), lambda i: i.isNotNull())
        end = lambda s, k: F.coalesce(F.try_element_at(s, k + 2), F.size(p))
        return let(at, lambda s: F.map_from_arrays(
            F.transform(s, lambda i: p[i]["w"]), F.transform(s, lambda i, k: F.transform(F.slice(p, i + 1, end(s, k) - i), lambda x: x["p"]))))

    return let(placed, runs)


@dataclass
class Term:
    words: tuple[str, ...]
    negated: bool = False


@dataclass
class Query:
    """OR of ANDs of terms; a term is a word or a phrase."""

    branches: list[list[Term]] = field(default_factory=list)

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(w for b in self.branches for t in b if not t.negated for w in t.words))


def parse_query(text: str) -> Query:
    """Words are AND-ed, ``or`` separates branches, ``-`` negates, quotes make a phrase."""
    branches: list[list[Term]] = [[]]
    for quoted, dash, word in re.findall(r'(-?"[^"]*"?)|(-?)([^\s"]+)', text):
        raw = quoted or dash + word
        if raw.lower() == "or":
            if branches[-1]:
                branches.append([])
            continue
        found = tuple(regex.findall(TOKEN, raw.lower()))  # cut as texts are, combining marks included
        if found:
            branches[-1].append(Term(found, raw.startswith("-")))
    return Query([b for b in branches if b])


def _has(vector: Column, t: Term) -> Column:
    present = F.lit(True)
    for w in t.words:
        present = present & F.map_contains_key(vector, w)
    if len(t.words) > 1:
        first = F.element_at(vector, t.words[0])
        present = present & F.coalesce(F.exists(first, lambda p: _follows(vector, t.words, p)), F.lit(False))
    return ~present if t.negated else present


def _follows(vector: Column, words: tuple[str, ...], p: Column) -> Column:
    ok = F.lit(True)
    for k, w in enumerate(words[1:], 1):
        ok = ok & F.array_contains(F.element_at(vector, w), p + k)
    return ok


def matches(vector: Column, query: Query) -> Column:
    """X09. A query without words matches nothing."""
    any_ = F.lit(False)
    for b in query.branches:
        all_ = F.lit(True)
        for t in b:
            all_ = all_ & _has(vector, t)
        any_ = any_ | all_
    return any_


def matches_tokens(words: Column, query: Query) -> Column:
    """X09 on the tokens in order, for texts without a stored vector: nothing is built for rows that do not match."""

    def has(t: Term) -> Column:
        if len(t.words) == 1:
            found = F.array_contains(words, t.words[0])
        else:
            at = lambda i: F.slice(words, i + 1, len(t.words)) == F.array(*map(F.lit, t.words))
            found = F.array_contains(words, t.words[0]) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at)
        found = F.coalesce(found, F.lit(False))
        return ~found if t.negated else found

    any_ = F.lit(False)
    for b in query.branches:
        all_ = F.lit(True)
        for t in b:
            all_ = all_ & has(t)
        any_ = any_ | all_
    return any_


def token_rank(words: Column, query: Query) -> Column:
    """``term_rank`` on the tokens."""
    return F.size(F.filter(words, lambda w: w.isin(*query.words))) if query.words else F.lit(0)


def term_rank(vector: Column, query: Query) -> Column:
    """Occurrences of the query's words in a text: a rank both engines can compute."""
    out = F.lit(0)
    for w in query.words:
        out = out + F.coalesce(F.size(F.try_element_at(vector, F.lit(w))), F.lit(0))
    return out


def cover_density(positions: list[list[int]]) -> float:
    """Rank of a text for an AND of words with these positions: the sum over minimal covers of 1 / their span, times the weight.

    A cover is a shortest stretch that holds every word; ``span`` is one more
    than the positions in it that are no query word, as in Clarke et al. One
    sweep over the merged positions, which increase in each list: what lies in
    a cover is told by places, not by counting.
    """
    if not positions or any(not p for p in positions):
        return 0.0
    last: list[tuple[int, int]] = [(-1, -1)] * len(positions)  # of each word: its last position, and its place among all
    total, before = 0.0, -1
    for place, (at, k) in enumerate(heapq.merge(*([(p, k) for p in ps] for k, ps in enumerate(positions)))):
        last[k] = at, place
        start, first = min(last)
        if start <= before:
            continue
        before = start
        noise = at - start - (place - first)
        total += WEIGHT / max(1, 1 + noise)
    return total


def cover_rank(query: Query, *, ordered: bool = False):
    """Arrow-batched rank over the position arrays of each branch's words; the best branch counts.

    The column is the entries of a stored vector or, with ``ordered``, the
    tokens of the text in order.
    """
    branches = [[w for t in b if not t.negated for w in t.words] for b in query.branches]

    @pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        def one(x):
            if ordered and x is not None:
                held: dict = {w: [] for w in query.words}
                for at, w in enumerate(x, 1):
                    if w in held:
                        held[w].append(min(at, POSITION_LIMIT))
            else:
                held = {e["key"]: e["value"] for e in x} if x is not None else {}
            return max((cover_density([list(held.get(w, ())) for w in b]) for b in branches if b), default=0.0)

        return v.map(one)

    return run
