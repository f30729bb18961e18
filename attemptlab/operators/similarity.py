"""Code-pair distances and similarities, all as Spark expressions.

* ``token_jaccard_distance`` – 1 - |A∩B| / |A∪B| over token sets.
* ``token_tree_distance`` – the flat token tree (root ``program`` over all
  tokens of the text) compared by unit-cost tree edit distance.  For two
  depth-1 trees with equal roots that distance is the edit distance of the
  child label sequences, so each pair's labels are encoded as characters and
  compared with ``levenshtein``.  Only equality across the two sides counts:
  each label that both sides have gets a character of its own, all others of
  a side share one.  (The source cuts the tree after 15 tokens; this does not.)
* ``token_tf_cosine`` – cosine of token-count vectors, computed with
  explode + two aggregations (partial, map-side) instead of per-row loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlab.functions import text as X

# Fixed value: label of the single node of an empty token tree.
EMPTY_TREE = "empty"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_jaccard_distance(a, b) -> Column:
    """Jaccard distance of the token sets (use ``add_jaccard_distance`` on large frames)."""
    return _jaccard(F.array_distinct(X.tokens(X.clean_code(_c(a)))), F.array_distinct(X.tokens(X.clean_code(_c(b)))))


def _jaccard(ta: Column, tb: Column) -> Column:
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(F.array_union(ta, tb))
    return (F.when((F.size(ta) == 0) & (F.size(tb) == 0), F.lit(0.0))
            .when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(1.0))
            .otherwise(F.lit(1.0) - inter.cast("double") / union.cast("double")))


def add_jaccard_distance(df: DataFrame, a: str, b: str, out: str = "jaccard_distance") -> DataFrame:
    """Token sets are computed once per row in their own projection, then compared."""
    staged = df.withColumn("_ta", F.array_distinct(X.tokens(X.clean_code(F.col(a))))) \
               .withColumn("_tb", F.array_distinct(X.tokens(X.clean_code(F.col(b)))))
    return staged.withColumn(out, _jaccard(F.col("_ta"), F.col("_tb"))).drop("_ta", "_tb")


def tree_labels(code) -> Column:
    return F.transform(X.tokens(X.clean_code(_c(code))), lambda t: F.regexp_replace(t, "[^a-zA-Z0-9_]", "_"))


# characters that stand for a label which the other side does not have
_ONLY_LEFT, _ONLY_RIGHT = "\u0001", "\u0002"


def _character(n: Column) -> Column:
    """The n-th character from U+0101 on, leaving out the surrogate range: over a million distinct ones."""
    code = n + F.lit(0x100) + F.when(n >= 0xD700, F.lit(0x800)).otherwise(F.lit(0))
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def label_characters(common: Column, missing: str) -> Column:
    """Character per position in ``common``, after the one for labels that are not in it."""
    each = F.when(F.size(common) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(common), F.lit(1))), _character)) \
        .otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(missing)), each)


def _encode(labels: Column, listed: Column, characters: Column) -> Column:
    """Labels as characters; ``listed`` is the comma-separated list of common labels (labels hold no comma)."""
    return F.array_join(F.transform(labels, lambda t: F.element_at(characters, F.find_in_set(t, listed) + 1)), "")


def unmatched(encoded: Column, missing: str) -> Column:
    """Positions of an encoded text whose label the other side does not have."""
    return F.length(encoded) - F.length(F.replace(encoded, F.lit(missing), F.lit("")))


def edit_bound(ea: Column, eb: Column) -> Column:
    """Lower bound of the edit distance of two encoded label sequences, without comparing them.

    At most as many positions match as the side with fewer common labels has of them; each other position of the
    longer side costs an edit.
    """
    na, nb = F.length(ea), F.length(eb)
    matches = F.least(na - unmatched(ea, _ONLY_LEFT), nb - unmatched(eb, _ONLY_RIGHT))
    return F.greatest(na, nb) - matches


def _tree_edit(la: Column, lb: Column, ea: Column, eb: Column, bound: Column, most: Column) -> Column:
    """Unit-cost edit distance of two flat token trees; null stands for more than ``most``.

    Pairs whose ``bound`` is already over ``most`` are not compared.
    """
    na, nb = F.size(la), F.size(lb)
    vs_empty = lambda n, other: F.when(F.array_contains(other, EMPTY_TREE), n).otherwise(n + 1)
    within = F.when(bound <= most, F.call_function("levenshtein", ea, eb, most))
    return (F.when((na == 0) & (nb == 0), F.lit(0))
            .when(na == 0, vs_empty(nb, lb))
            .when(nb == 0, vs_empty(na, la))
            .when(within >= 0, within))


def add_tree_distance(df: DataFrame, a: str, b: str, out: str = "ast_edit_distance") -> DataFrame:
    """Tree edit distance / mean word count, capped at 1.

    Each text is cleaned and scanned once; labels, common labels and their characters are columns (a lambda body
    is evaluated per element, so it must only read columns).  Because the result is capped at 1, pairs are only
    compared while the bound leaves less than the mean word count, and only followed up to it.
    """
    staged = (df.withColumn("_ca", X.clean_code(F.col(a))).withColumn("_cb", X.clean_code(F.col(b)))
              .withColumn("_la", tree_labels(F.col("_ca"))).withColumn("_lb", tree_labels(F.col("_cb")))
              .withColumn("_avg", (X.word_count(F.col("_ca")) + X.word_count(F.col("_cb"))).cast("double") / 2.0)
              .drop("_ca", "_cb")
              .withColumn("_both", F.array_intersect("_la", "_lb"))
              .withColumn("_list", F.array_join("_both", ","))
              .withColumn("_xa", label_characters(F.col("_both"), _ONLY_LEFT))
              .withColumn("_xb", label_characters(F.col("_both"), _ONLY_RIGHT))
              .withColumn("_ea", _encode(F.col("_la"), F.col("_list"), F.col("_xa")))
              .withColumn("_eb", _encode(F.col("_lb"), F.col("_list"), F.col("_xb")))
              .withColumn("_bound", edit_bound(F.col("_ea"), F.col("_eb"))))
    scale = F.greatest(F.col("_avg"), F.lit(1.0))
    dist = _tree_edit(F.col("_la"), F.col("_lb"), F.col("_ea"), F.col("_eb"), F.col("_bound"), F.floor(scale).cast("int"))
    value = F.when(F.col("_avg") == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.least(F.lit(1.0), dist.cast("double") / scale), F.lit(1.0)))
    return staged.withColumn(out, value).drop("_la", "_lb", "_avg", "_both", "_list", "_xa", "_xb", "_ea", "_eb", "_bound")


def char_levenshtein(a, b) -> Column:
    return F.levenshtein(_c(a), _c(b))


def token_tf_cosine(pairs: DataFrame, id_cols: list[str], left: str, right: str,
                    out: str = "codebert_cosine_similarity", carry: list[str] = ()) -> DataFrame:
    """Cosine of the token-count vectors of two texts, per pair; 0.0 if either has no token.

    One pass: each pair row becomes one row per token (side, token) – the
    texts themselves never cross a shuffle – and counts per (pair, token)
    are combined map-side before the exchange.  Pairs are keyed by
    ``id_cols`` plus a hash of both texts; a repeated pair only scales both
    count vectors by the same factor, which leaves the cosine unchanged.
    ``carry`` columns (constant per pair) are kept through the aggregation;
    ``pair_rows`` tells how many input rows held the pair.
    """
    key = [*id_cols, "_pk"]
    carry = list(carry)
    tl = X.tokens(X.clean_code(F.col(left)))
    tr = X.tokens(X.clean_code(F.col(right)))
    both = F.concat(F.transform(tl, lambda t: F.struct(F.lit(0).alias("side"), t.alias("token"))),
                    F.transform(tr, lambda t: F.struct(F.lit(1).alias("side"), t.alias("token"))))
    toks = (pairs.select(*id_cols, F.xxhash64(F.col(left), F.col(right)).alias("_pk"), *carry, both.alias("_b"))
            .select(*key, *carry, F.greatest(F.size("_b"), F.lit(1)).alias("_ntok"), F.explode_outer("_b").alias("_t")))
    counts = toks.groupBy(*key, F.col("_t")["token"].alias("token")).agg(
        *[F.first(c).alias(c) for c in [*carry, "_ntok"]], F.count(F.lit(1)).alias("_c"),
        F.count_if(F.col("_t")["side"] == 0).cast("double").alias("l"),
        F.count_if(F.col("_t")["side"] == 1).cast("double").alias("r"))
    sums = counts.groupBy(*key).agg(*[F.first(c).alias(c) for c in carry],
                                    (F.sum("_c") / F.first("_ntok")).cast("long").alias("pair_rows"),
                                    F.sum(F.col("l") * F.col("r")).alias("xy"),
                                    F.sum(F.col("l") * F.col("l")).alias("xx"),
                                    F.sum(F.col("r") * F.col("r")).alias("yy"))
    cos = F.try_divide(F.col("xy"), F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.sqrt("xx") * F.sqrt("yy")))
    return sums.select(*id_cols, *carry, "pair_rows", F.coalesce(cos, F.lit(0.0)).alias(out))


def code_similarity_table(pairs: DataFrame, id_cols: list[str], left: str = "LLM_response",
                          right: str = "student_response") -> DataFrame:
    """One row per input pair: ids, ``ast_edit_distance`` and ``codebert_cosine_similarity``.

    Null texts read as ``nan``.  Each distinct pair is scored once.
    """
    p = pairs.withColumn(left, F.coalesce(F.col(left), F.lit("nan"))) \
             .withColumn(right, F.coalesce(F.col(right), F.lit("nan")))
    p = add_tree_distance(p, left, right)
    t = token_tf_cosine(p, id_cols, left, right, carry=["ast_edit_distance"])
    # back to one row per input pair row (means over pairs count repeated pairs, as the source does)
    return t.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("pair_rows")))).drop("_rep", "pair_rows")
