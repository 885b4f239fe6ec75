"""Companies by their names."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.text import osa_distance, strip_marks, token_jaccard
from ledgerline.storage import materialize

THRESHOLD = 0.85
# Legal forms that are no part of a name.
LEGAL_FORMS = ("ab", "as", "ou", "oü", "uab", "sia", "ipas", "asa", "oyj", "plc", "ltd", "inc")


def raw_tokens(name: Column) -> Column:
    """Lower-case words; the legal form A/S is left out, punctuation separates."""
    s = F.lower(F.regexp_replace(name, r"(?i)(?<![A-Za-z0-9_])a\s*/\s*s(?![A-Za-z0-9_])", " "))
    s = F.regexp_replace(s, r"""[.,;:()'"„“”’/\\&]""", " ")
    return F.filter(F.split(s, r"\s+"), lambda x: x != "")


def name_tokens(name: Column, audit: bool = False) -> Column:
    """raw_tokens() without legal forms; an audit also strips marks."""
    tokens = raw_tokens(strip_marks(name) if audit else name)
    return F.filter(tokens, lambda x: ~x.isin(*LEGAL_FORMS))


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _words(tokens: Column, other: Column, raw: Column, ticker: Column) -> Column:
    """Common words, or the ticker among the words."""
    listed = F.when(F.array_contains(raw, F.lower(ticker)), 1.0).otherwise(0.0)
    return F.greatest(token_jaccard(tokens, other), F.coalesce(listed, F.lit(0.0)))


def _swaps_decide(far: Column, longest: Column, threshold: float) -> Column:
    """Whether only swaps can bring letters to the threshold: a swap of neighbours is two edits at most, so Levenshtein bounds it from both sides."""
    return (longest > 0) & (1 - far / longest < threshold) & (far <= 2 * (1 - threshold) * longest + 1e-9)


def reach(pairs: DataFrame, threshold: float) -> DataFrame:
    """Adds fits to pairs (x, y, raw, ticker, ...): whether their confidence is ``threshold`` or more."""
    pairs = pairs.withColumn("a_", _joined(F.col("x"))).withColumn("b_", _joined(F.col("y"))).withColumn("sure_", _words(F.col("x"), F.col("y"), F.col("raw"), F.col("ticker")) >= threshold)
    longest = F.greatest(F.length("a_"), F.length("b_"))
    pairs = pairs.withColumn("far_", F.levenshtein("a_", "b_")).withColumn("longest_", longest)
    open_ = ~F.col("sure_") & _swaps_decide(F.col("far_"), F.col("longest_"), threshold)
    near = F.coalesce(1 - F.col("far_") / F.nullif("longest_", F.lit(0)) >= threshold, F.lit(False))
    # the exact distance is worked out once for each two texts it decides on
    texts = pairs.where(open_).select("a_", "b_").distinct()
    exact = texts.withColumn("swapped_", 1 - osa_distance(F.col("a_"), F.col("b_")) / F.greatest(F.length("a_"), F.length("b_")) >= threshold).where("swapped_")
    joined = pairs.join(exact, ["a_", "b_"], "left")
    return joined.withColumn("fits", F.col("sure_") | near | F.coalesce("swapped_", F.lit(False))).drop("a_", "b_", "sure_", "far_", "longest_", "swapped_")


def mismatches(reports: DataFrame, companies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, reason, suggested_company_id) of the reports whose extracted company is not the one they are filed under.

    reports (id, company_id, extracted), companies (id, name, ticker, ord).
    Reports without a company or an extracted name are not judged.  A company
    that the catalogue has not gets no suggestion; else the suggestion is the
    best company by ``threshold`` or more, null if there is none.
    """
    r = reports.where(F.col("company_id").isNotNull() & (F.trim("extracted") != "")).select(F.col("id").alias("doc"), "company_id", F.trim("extracted").alias("name"))
    # written once, as reports are read for each reason, and texts for those whose swaps decide
    joined = materialize(r.join(companies.select(F.col("id").alias("company_id"), F.lit(True).alias("listed"), F.col("name").alias("own"), "ticker"), "company_id", "left"), "filed-names")
    missing = joined.where("listed is null").select(F.col("doc").alias("id"), F.lit("not_in_catalogue").alias("reason"), F.lit(None).cast(companies.schema["id"].dataType).alias("suggested_company_id"))
    tokens = joined.where("listed").select("doc", "name", name_tokens(F.col("name"), True).alias("x"), name_tokens(F.col("own"), True).alias("y"), raw_tokens(F.col("name")).alias("raw"), "ticker")
    unlike = materialize(reach(tokens, threshold).where(~F.col("fits")).select("doc", "name"), "unlike-names")
    # each name is looked for once, however many reports have it
    names = unlike.select("name").distinct().select(F.col("name").alias("doc"), "name")
    best = match_companies(names, companies, threshold, audit=True).select(F.col("doc").alias("name"), F.col("company_id").alias("suggested_company_id"))
    return missing.unionByName(unlike.join(best, "name", "left").select(F.col("doc").alias("id"), F.lit("unlike_catalogue").alias("reason"), "suggested_company_id"))


#: Letters in a row by which names are compared before any distance is.
GRAM = 3
#: Least threshold at which near names must share some of them: a swap touches GRAM + 1, and so many edits leave one.
LEAST = (GRAM + 1) / (GRAM + 2)


def _grams(text: Column) -> Column:
    """Each three letters in a row of the padded text, numbered where they come again."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: F.substr(padded, i, F.lit(GRAM)))
    numbered = lambda g: F.transform(g, lambda x, i: F.concat(F.lit("g:"), x, F.size(F.filter(F.slice(g, F.lit(1), i), lambda y: y == x)).cast("string")))
    return F.transform(F.array(grams), numbered)[0]


def _keys(rows: DataFrame, own: str, threshold: float) -> DataFrame:
    """(own, kind, key, need): all keys of a text, and how many of a kind, the rarest first, must do.

    Texts whose letters are alike by the threshold differ in k letters at most,
    so in k * (GRAM + 1) grams; words in what of a word set may be missing.
    Sets of few words are alike if they are equal only, and have no word keys.
    """
    n = F.length(own)
    edits = F.floor((1 - threshold) / threshold * n + 1e-9)
    of = lambda keys, kind, need: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), need.cast("int").alias("need")))
    words = F.array_distinct(F.transform(F.split(own, " "), lambda x: F.concat(F.lit("w:"), x)))
    many = F.when(F.size(words) >= threshold / (1 - threshold) - 1e-9, words).otherwise(F.array().cast("array<string>"))
    both = F.concat(of(_grams(F.col(own)), "g", edits * (GRAM + 1) + 1), of(many, "w", F.floor((1 - threshold) * F.size(words) + 1e-9) + 1))
    return rows.select(own, F.explode(both).alias("k")).select(own, "k.kind", "k.key", "k.need")


#: Parts of the texts that share a key; each meets the companies' texts by itself.
SALTS = 16


def _near(texts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of all pairs whose letters or words may be alike by the threshold.

    Of each text only its rarest keys are joined, by how many companies' texts
    have them; two near ones share one of those.  So common letters meet
    nowhere.  Lengths and edits are looked at where pairs meet, so what is
    passed on is near.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = _keys(texts, "a", threshold), _keys(classes, "b", threshold)
    common = right.groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def rarest(keys: DataFrame, own: str, how: str) -> DataFrame:
        turn = F.row_number().over(W.partitionBy(own, "kind").orderBy(F.coalesce("n", F.lit(0)), "key"))
        # keys that no company has are the rarest, so they take a turn
        return keys.join(common, "key", how).withColumn("turn", turn).where("turn <= need and n is not null").select(own, "kind", "key")

    # few rows make very many pairs, so the number of tasks is given
    asked = rarest(left, "a", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).repartition(parts, "key", "salt")
    held = rarest(right, "b", "inner").drop("kind").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(parts, "key", "salt")
    longest = F.greatest(F.length("a"), F.length("b"))
    lengths = F.abs(F.length("a") - F.length("b")) <= (1 - threshold) * longest + 1e-9
    bound = F.floor(2 * (1 - threshold) * longest + 1e-9).cast("int")
    met = asked.join(held, ["key", "salt"]).where((F.col("kind") == "w") | lengths)
    near = met.where((F.col("kind") == "w") | (F.call_function("levenshtein", F.col("a"), F.col("b"), bound) >= 0))
    return near.select("a", "b").repartition(parts, "a").dropDuplicates(["a", "b"])


def _best_texts(texts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, confidence, first): of texts the best of classes (b, first), by ``threshold`` or more, by letters and words; of equal ones the first."""
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    key = lambda df, own: df.withColumn("words_", words(F.col(own)))
    # the same words are as good as it gets; what has none is looked for by letters
    same = materialize(key(texts, "a").join(key(classes, "b"), "words_").groupBy("a").agg(F.min("first").alias("first")), "same-words")
    pairs = _near(texts.join(same.select("a"), "a", "left_anti"), classes, threshold)
    longest = F.greatest(F.length("a"), F.length("b"))
    scored = pairs.withColumn("words_", token_jaccard(F.split("a", " "), F.split("b", " "))).withColumn("far_", F.levenshtein("a", "b")).withColumn("longest_", longest)
    least = F.greatest(F.col("words_"), 1 - F.col("far_") / F.col("longest_"))
    most = F.greatest(F.col("words_"), 1 - F.ceil(F.col("far_") / 2) / F.col("longest_"))
    # the exact distance is worked out only where it can make the best
    scored = scored.withColumn("sure_", F.max(least).over(W.partitionBy("a"))).where((most >= F.col("sure_") - 1e-9) & (most >= threshold - 1e-9))
    few = materialize(scored.select("a", "b", "words_", "far_", "longest_"), "near-names")
    exact = few.where("far_ > 1").withColumn("far_", osa_distance(F.col("a"), F.col("b")))
    done = few.where("far_ <= 1").unionByName(exact).withColumn("confidence", F.greatest(F.col("words_"), 1 - F.col("far_") / F.col("longest_"))).where(F.col("confidence") >= threshold)
    best = done.join(classes, "b").groupBy("a").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "first")).alias("m")).select("a", (-F.col("m.less")).alias("confidence"), "m.first")
    return same.select("a", F.lit(1.0).alias("confidence"), "first").unionByName(best)


def _named(names: DataFrame, audit: bool) -> DataFrame:
    return names.select("doc", "name", name_tokens(F.col("name"), audit).alias("x"), raw_tokens(F.col("name")).alias("raw")).where(F.size("x") > 0)


def _listed(companies: DataFrame, audit: bool) -> DataFrame:
    rows = companies.select(F.col("id").alias("company_id"), "ord", "ticker", name_tokens(F.col("name"), audit).alias("y"))
    return rows.where(F.size("y") > 0) if audit else rows


def _texts(companies: DataFrame) -> DataFrame:
    """(b, first): the names that are left of companies without legal forms, each with the first company (ord, company_id) that has it."""
    return companies.where(F.size("y") > 0).groupBy(_joined(F.col("y")).alias("b")).agg(F.min(F.struct("ord", "company_id")).alias("first"))


def match_companies(names: DataFrame, companies: DataFrame, threshold: float = THRESHOLD, audit: bool = False) -> DataFrame:
    """(doc, name, company_id, confidence): the company each name fits best, if by ``threshold`` or more.

    names (doc, name) with each doc once, companies (id, name, ticker, ord).  Of
    equally good companies the first by ord.  Names that are the same without
    their legal forms are looked for once.  Pairs come from an equi-join of rare
    keys that misses none; that needs a threshold of LEAST or more, else see
    best_companies().
    """
    if threshold < LEAST:
        raise ValueError(f"threshold below {LEAST}: use best_companies()")
    # written once, as names are read for their letters, their tickers and the answer
    n = materialize(_named(names, audit).withColumn("a", _joined(F.col("x"))).select("doc", "name", "a", "raw"), "names")
    c = materialize(_listed(companies, audit), "companies")
    best = _best_texts(n.select("a").distinct(), _texts(c), threshold)
    listed = c.where(F.coalesce("ticker", F.lit("")) != "").select(F.lower("ticker").alias("key"), F.struct("ord", "company_id").alias("first"))
    by_ticker = n.select("doc", F.explode(F.array_distinct("raw")).alias("key")).join(listed, "key").groupBy("doc").agg(F.min("first").alias("listed_"))
    joined = n.join(best, "a", "left").join(by_ticker, "doc", "left")
    # a ticker among the words is as good as equal names
    whole = F.coalesce(F.col("confidence") == 1.0, F.lit(False))
    first = F.when(whole, F.least("first", "listed_")).otherwise(F.coalesce("listed_", "first"))
    return joined.withColumn("first", first).where("first is not null").select("doc", "name", "first.company_id", F.when(F.col("listed_").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))


# --- the best of all, however unlike ----------------------------------------------------------------------------------

#: Rows of names and of companies that meet in one task.
NAME_BLOCK, COMPANY_BLOCK = 200, 20_000
_BUCKETS = 64


def osa_many(a: str, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edits and swaps of neighbours between a name and each of many (a column of letter codes each), all at once."""
    width, n = others.shape
    before, last = None, np.repeat(np.arange(width + 1, dtype=np.int32)[:, None], n, 1)
    codes = [ord(x) for x in a]
    for i, x in enumerate(codes):
        row = np.empty_like(last)
        row[0] = i + 1
        same = others == x
        for j in range(width):
            best = np.minimum(np.minimum(last[j + 1], row[j]) + 1, last[j] + ~same[j])
            if i and j:
                swap = same[j - 1] & (others[j] == codes[i - 1])
                best = np.where(swap, np.minimum(best, before[j - 1] + 1), best)
            row[j + 1] = best
        before, last = last, row
    return last[lengths, np.arange(n)]


def _bags(texts: Iterable[str]) -> np.ndarray:
    """How often letters come in each text, some letters together."""
    return np.array([np.bincount([ord(x) % _BUCKETS for x in t], minlength=_BUCKETS) for t in texts], np.int16).reshape(-1, _BUCKETS)


def _best_of_block(names: pd.DataFrame, companies: pd.DataFrame) -> pd.DataFrame:
    """For each text the best of the block's companies: (a, confidence, ord, company_id)."""
    if companies.empty:
        return pd.DataFrame([], columns=["a", "confidence", "ord", "company_id"])
    companies = companies.sort_values("ord", kind="stable").reset_index(drop=True)
    texts = list(companies["b"])
    lengths, bags = np.array([len(t) for t in texts]), _bags(texts)
    codes = np.zeros((max(1, lengths.max(initial=1)), len(texts)), np.int32)
    for k, t in enumerate(texts):
        codes[: len(t), k] = [ord(x) for x in t]
    sets, by_word = [set(t.split(" ")) for t in texts], {}
    for k, words in enumerate(sets):
        for w in words:
            by_word.setdefault(w, []).append(k)
    out = []
    for a in names["a"]:
        words, score = set(a.split(" ")), np.zeros(len(texts))
        for k in {k for w in words for k in by_word.get(w, ())}:
            score[k] = len(words & sets[k]) / len(words | sets[k])
        longest = np.maximum(lengths, len(a))
        most = np.minimum(bags, _bags([a])).sum(1) / longest  # no distance makes more of it
        tried = np.argpartition(-most, 63)[:64] if len(most) > 64 else np.arange(len(most))
        for part in (tried, None):
            if part is None:
                part = np.setdiff1d(np.flatnonzero((most >= score.max()) & (most > score)), tried)
            if len(part):
                score[part] = np.maximum(score[part], 1 - osa_many(a, codes[:, part], lengths[part]) / longest[part])
        k = int(score.argmax())  # the first of the best
        if score[k] > 0:
            out.append((a, float(score[k]), companies["ord"][k], companies["company_id"][k]))
    return pd.DataFrame(out, columns=["a", "confidence", "ord", "company_id"])


def best_companies(names: DataFrame, companies: DataFrame, audit: bool = True) -> DataFrame:
    """(doc, name, company_id, confidence): the company each name fits best, by however little above 0; equal ones by ord.

    Names that fit one by THRESHOLD or more have it from match_companies().
    What is left names no ticker; each of its texts is compared with all texts
    of companies, a block of names with a block of companies at a time; a bound
    from the letters that two texts share leaves few distances to work out.
    names (doc, name) with each doc once.
    """
    sure = materialize(match_companies(names, companies, THRESHOLD, audit), "sure-names")
    n = materialize(_named(names.join(sure.select("doc"), "doc", "left_anti"), audit).select("doc", "name", _joined(F.col("x")).alias("a")), "other-names")
    left, right = n.select("a").distinct(), _texts(_listed(companies, audit)).select("b", "first.ord", "first.company_id")
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((left, NAME_BLOCK), (right, COMPANY_BLOCK)))
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # a block takes seconds however few its bytes are, so the number of tasks is given
    tasks = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts * blocks, 1_000))
    left = left.select("a", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int").alias("part"), all_of(blocks).alias("block")).repartition(tasks, "part", "block")
    right = right.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int")).withColumn("part", all_of(parts)).repartition(tasks, "part", "block")
    types = {f.name: f.dataType.simpleString() for f in right.schema}
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(_best_of_block, f"a string, confidence double, ord {types['ord']}, company_id {types['company_id']}")
    best = found.groupBy("a").agg(F.max(F.struct("confidence", (-F.col("ord")).alias("first"), "company_id")).alias("b"))
    return sure.unionByName(n.join(best, "a").select("doc", "name", "b.company_id", "b.confidence"))
