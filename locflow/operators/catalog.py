"""Keys and catalogs: derive, merge first-wins, compare with constants.

STR-02/03/04/05, JN-01/02/03/05, SET-03/04, Q12, STR-01, SNK-04.

Order is always explicit: ``seq`` is a struct of source-order columns (file,
line or ordinal), and "first" means the smallest ``seq``; partition order is
never relied on. Every keyed step aggregates partially before it shuffles, so a
hot key costs one row per task on the wire, not one per occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.functions import text as T
from locflow.operators.skew import heavy_keys, hot_keys, hot_rows, salted_join, staged_join
from locflow.session import stage

CATALOG_COLUMNS = ("lang", "key", "source", "target", "translate", "origin", "seq")


def derive_keys(texts: DataFrame, text_col: str = "text", lang_col: str = "lang",
                order_cols=(), explicit_col: str | None = None, materialize: bool = False) -> DataFrame:
    """``(lang, text, key, first_seen, uses, texts_per_key, key_uses)`` (STR-03).

    Distinct texts per language (partial aggregation), the PascalCase key of
    each (explicit key wins), and how many distinct texts share that key.
    Texts whose key is blank are refused (FLT-01, Q24).

    What is long is shuffled as seldom as can be: a key that follows from its
    text is never shuffled, its digest is; keys are counted over digests of
    keys and texts; so each text moves twice, once to become distinct and once
    to meet its key's count. ``materialize=True`` checkpoints the distinct
    texts into the session's checkpoint folder (for callers that read them
    again later).
    """
    first = (F.min(F.struct(*[F.col(c) for c in order_cols])).alias("first_seen")
             if order_cols else F.lit(None).cast("string").alias("first_seen"))
    aggs = [first, F.count(F.lit(1)).alias("uses")]
    base = texts.filter(~T.is_blank(text_col) if explicit_col else T.has_key(text_col))
    lang, text = F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    if explicit_col:
        d = base.groupBy(lang, text).agg(*aggs, F.min(explicit_col).alias("_explicit"))
        d = d.withColumn("key", T.key_for("text", explicit="_explicit")).drop("_explicit").filter(F.length("key") > 0)
        d = d.withColumn("_key_id", T.digest("key"))
    else:
        key_id = T.digest(T.pascal_key(text_col)).alias("_key_id")
        d = base.groupBy(lang, text, key_id).agg(*aggs)
    if materialize:
        d = stage(d, "distinct_texts")
    size = F.octet_length("text").cast("bigint")
    if materialize or explicit_col:
        pairs = d.select("lang", "_key_id", "uses", size.alias("_size"))
    else:   # the same pairs without the texts
        pairs = base.groupBy(lang, key_id, T.digest(text_col).alias("_text_id")).agg(
            F.count(F.lit(1)).alias("uses"), F.max(F.octet_length(text_col).cast("bigint")).alias("_size"))
    # The count per key is a partial aggregation joined back: a hot key costs one count row, and its texts are spread
    # over salts (a window over the key would put them all in one task).
    per_key = pairs.groupBy("lang", "_key_id").agg(F.count(F.lit(1)).alias("texts_per_key"), F.sum("uses").alias("key_uses"),
                                                   F.sum("_size").alias("_size"))
    hot = heavy_keys(per_key, ["lang", "_key_id"], "texts_per_key", "_size")
    out = salted_join(d, per_key.drop("_size"), ["lang", "_key_id"], "inner", hot=hot, salt_cols=["lang", "text"])
    key = F.col("key") if explicit_col else T.pascal_key("text").alias("key")
    return out.select("lang", "text", key, "first_seen", "uses", "texts_per_key", "key_uses")


def key_set(texts: DataFrame, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """Distinct keys of non-blank texts (``key`` or ``(lang, key)``), one partial aggregation.

    For membership tests (known keys, catalog keys) where the per-key text
    count of ``derive_keys`` is not needed.
    """
    cols = ([F.col(lang_col).alias("lang")] if lang_col else []) + [T.pascal_key(text_col).alias("key")]
    return texts.filter(T.has_key(text_col)).select(*cols).distinct()


def key_conflicts(keys: DataFrame) -> DataFrame:
    """Texts that lose their key to an earlier text (Q12): ``(lang, key, text, winner)``.

    Only keys shared by several texts take part, few of all; they are staged,
    and what follows reads no other text. The winner is the text with the
    smallest ``first_seen`` (then the smaller text) and is found by one partial
    ``min`` per key, never a per-key list, joined back by salts. Of inputs that
    carry a ``winner`` this is a filter.
    """
    if "winner" in keys.columns:
        return (keys.filter((F.col("texts_per_key") > 1) & (F.col("text") != F.col("winner")))
                    .select("lang", "key", "text", "winner"))
    shared = stage(keys.filter(F.col("texts_per_key") > 1).select("lang", "key", "text", "first_seen"), "shared-keys")
    win = (shared.groupBy("lang", "key")
                 .agg(F.min(F.struct("first_seen", "text")).alias("_w"), F.count(F.lit(1)).alias("_n"))
                 .select("lang", "key", F.col("_w.text").alias("winner"), "_n"))
    hot = hot_keys(win, ["lang", "key"], "_n")
    return (salted_join(shared, win.drop("_n"), ["lang", "key"], "inner", hot=hot, salt_cols=["lang", "text"])
                  .filter(F.col("text") != F.col("winner"))
                  .select("lang", "key", "text", "winner"))


def catalog_rows(texts: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 key_col: str | None = None, order_cols=(), origin: str = "batch",
                 source_col: str | None = None, legacy_source: bool = False) -> DataFrame:
    """Shape texts as catalog rows ``(lang, key, source, target, translate, origin, seq)``.

    The text goes to ``target``; ``source`` is the pivot text when given, else
    the text (Q23 fixed); ``legacy_source=True`` writes the empty source the
    reference wrote.
    """
    key = F.col(key_col) if key_col else T.pascal_key(text_col)
    seq = F.struct(*[F.col(c) for c in order_cols]) if order_cols else F.struct(F.lit(0).alias("n"))
    source = F.col(source_col) if source_col else F.col(text_col)
    if legacy_source:
        source = F.lit("")
    # a filter on a derived key would derive it a second time, so the text tells whether there will be one
    keyed = ~T.is_blank(text_col) & (F.length(key_col) > 0) if key_col else T.has_key(text_col)
    return texts.filter(keyed).select(
        F.col(lang_col).alias("lang"), key.alias("key"), source.alias("source"), F.col(text_col).alias("target"),
        F.lit(True).alias("translate"), F.lit(origin).alias("origin"), seq.alias("seq"))


def first_wins(rows: DataFrame, with_count: bool = False) -> DataFrame:
    """One row per ``(lang, key)``: the one with the smallest ``seq`` (SET-03).

    ``with_count`` adds ``_n``, the rows per key (used to find hot keys).
    """
    cols = [c for c in rows.columns if c not in ("lang", "key")]
    w = rows.groupBy("lang", "key").agg(F.min(F.struct("seq", *[c for c in cols if c != "seq"])).alias("_w"),
                                        F.count(F.lit(1)).alias("_n"))
    out = w.select("lang", "key", *[F.col(f"_w.{c}").alias(c) for c in cols], "_n")
    return out if with_count else out.drop("_n")


def upsert_catalog(catalog: DataFrame, batch: DataFrame, materialize: bool = False):
    """Insert-if-absent by ``(lang, key)`` (JN-02, SET-03, Q12) → ``(inserted, key_conflicts)``.

    * the batch is reduced to its first row per key (partial ``min``);
    * keys absent from the catalog are ``inserted`` (a unit of the catalog counts as present whatever its target is);
    * a batch text that loses its key, to an earlier batch row or to the
      catalog's existing text, is recorded in ``key_conflicts(lang, key,
      kept, dropped, against)``; equal texts are no conflict.

    The batch winners and the catalog meet in one join on ``(lang, key)``; the
    aggregation already partitioned the batch by those keys, so only the
    catalog is shuffled (or broadcast by AQE when it is measured small). The
    losers' join back to the winners of keys with several texts salts keys that hold too many of them.
    ``materialize=True`` writes the batch's distinct texts to the checkpoint
    folder first: winners, hot keys and losers then read that table and the
    batch is computed once.
    """
    # one row per distinct text, its first occurrence; winners are an aggregate over these rows, so both branches
    # read one exchange. A source that is the target is not written and shuffled beside it.
    same = F.col("source").eqNullSafe(F.col("target"))
    rest = [c for c in batch.columns if c not in ("lang", "key", "target", "seq", "source")]
    first = F.struct("seq", F.when(~same, F.col("source")).alias("source"), same.alias("_same"), *rest)
    texts = batch.groupBy("lang", "key", "target").agg(F.min(first).alias("_f")).select("lang", "key", "target", "_f.*")
    if materialize:
        texts = stage(texts, "distinct")
    counted = first_wins(texts, with_count=True)
    # both readers of the winners keep the count, so that they read one exchange
    win = counted.where("_n > 0").withColumn("source", F.when(F.col("_same"), F.col("target")).otherwise(F.col("source"))).drop("_same", "_n")
    existing = catalog.groupBy("lang", "key").agg(F.min("target").alias("_existing"), F.lit(True).alias("_present"))
    j = win.join(existing, ["lang", "key"], "left")
    inserted = j.filter(F.col("_present").isNull()).drop("_existing", "_present")
    vs_catalog = (j.filter(F.col("_present") & ~F.col("_existing").eqNullSafe(F.col("target")))
                   .select("lang", "key", F.col("_existing").alias("kept"),
                           F.col("target").alias("dropped"), F.lit("catalog").alias("against")))
    # a text meets the winner of its key by the key's digest; the key itself comes with the few shared ones
    key_id = F.coalesce(T.digest("key"), F.lit(b"")).alias("_key_id")
    by_key = texts.select("lang", "target", key_id)
    shared = counted.filter("_n > 1 and lang is not null and key is not null").select("lang", key_id, "key", F.col("target").alias("_w"))
    hot = hot_rows(by_key, ["lang", "_key_id"], size_cols=["target"])
    losers = (salted_join(by_key, shared, ["lang", "_key_id"], "inner", hot=hot, salt_cols=["lang", "target"])
                   .filter(F.col("target") != F.col("_w"))
                   .select("lang", "key", F.col("_w").alias("kept"), F.col("target").alias("dropped"),
                           F.lit("batch").alias("against")))
    return inserted.select(*CATALOG_COLUMNS), vs_catalog.unionByName(losers)


def to_catalog_rows(texts: DataFrame, pivot: str = "en", text_col: str = "text",
                    lang_col: str = "lang", translation_col: str = "translation",
                    key_col: str = "key") -> DataFrame:
    """Route by language (JN-05): own-language row, plus the pivot row when translated.

    A non-pivot text with a translation writes ``(lang, key, text)`` and
    ``(pivot, key, translation)`` under the same key; a pivot text, or one
    without translation, writes only its own row. Narrow: explode of at most
    two structs per text.
    """
    own = F.struct(F.col(lang_col).alias("lang"), F.col(text_col).alias("target"))
    piv = F.struct(F.lit(pivot).alias("lang"), F.col(translation_col).alias("target"))
    has_pivot = (F.col(lang_col) != pivot) & F.col(translation_col).isNotNull() & ~T.is_blank(translation_col)
    rows = F.when(has_pivot, F.array(own, piv)).otherwise(F.array(own))
    keep = [c for c in texts.columns if c not in (lang_col, text_col, translation_col)]
    return (texts.select(*keep, F.explode(rows).alias("_r"))
                 .select(*keep, F.col("_r.lang").alias("lang"), F.col("_r.target").alias("target")))


def known_keys(df: DataFrame, constants: DataFrame, key_col: str = "key", hot: DataFrame | None = None) -> DataFrame:
    """Rows whose key is already declared (JN-01), ``left_semi``; a hot key's rows are spread over salts.

    Without ``hot`` (as of ``skew.hot_keys``) the keys of ``df`` are counted,
    so pass a staged table or the counts at hand.
    """
    return salted_join(df, constants.select(F.col("key").alias(key_col)).distinct(), [key_col], "left_semi", hot=hot)


def new_keys(df: DataFrame, constants: DataFrame, key_col: str = "key", hot: DataFrame | None = None,
             staged: bool = False) -> DataFrame:
    """Rows whose key is not declared yet (JN-01), ``left_anti``; salted as ``known_keys``, of a ``staged`` table only
    where a key is hot."""
    if staged:
        return staged_join(df, constants.select(F.col("key").alias(key_col)).distinct(), [key_col], "left_anti")
    return salted_join(df, constants.select(F.col("key").alias(key_col)).distinct(), [key_col], "left_anti", hot=hot)


def missing_constants(catalog: DataFrame, constants: DataFrame) -> DataFrame:
    """Catalog keys without a constant (JN-03): distinct ``key``."""
    return catalog.select("key").distinct().join(constants.select("key").distinct(), "key", "left_anti")


def compare_keys(catalog: DataFrame, constants: DataFrame) -> DataFrame:
    """Two-list comparison (SET-04): ``(key, side)`` with ``both``/``only_catalog``/``only_constants``."""
    a = catalog.select("key").distinct().withColumn("_a", F.lit(True))
    b = constants.select("key").distinct().withColumn("_b", F.lit(True))
    j = a.join(b, "key", "full_outer")
    side = (F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_catalog")
             .otherwise("only_constants"))
    return j.select("key", side.alias("side"))


def trim_units(catalog: DataFrame, cols=("source", "target")) -> DataFrame:
    """Trim Unicode white space off catalog texts (STR-01); adds ``changed``.

    Only non-empty texts with a blank edge change; the rest pass through.
    """
    changed = F.lit(False)
    out = catalog
    for c in cols:
        trimmed = T.ws_trim(c)
        changed = changed | (F.coalesce(F.col(c), F.lit("")) != F.coalesce(trimmed, F.lit("")))
        out = out.withColumn(f"_t_{c}", trimmed)
    out = out.withColumn("changed", changed)
    for c in cols:
        out = out.withColumn(c, F.col(f"_t_{c}")).drop(f"_t_{c}")
    return out


def render_declarations(keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Constant declaration and lookup expression per key (STR-04, STR-05, SNK-04)."""
    return keys.select(F.col(key_col).alias("key"), T.const_decl(key_col).alias("declaration"),
                       T.lookup_expr(key_col).alias("lookup"))


def write_declarations(decls: DataFrame, path: str, parts: int | None = None) -> None:
    """Declarations as text, range-partitioned and sorted by key (SNK-04).

    Range partitioning keeps every output file sorted and disjoint without
    funnelling all keys through one task.
    """
    d = decls.repartitionByRange(parts, "key") if parts else decls.repartitionByRange("key")
    d.sortWithinPartitions("key").select("declaration").write.mode("overwrite").text(path)


def insert_declarations(lines: DataFrame, decls: DataFrame, first_line_no: DataFrame,
                        path_col: str = "path") -> DataFrame:
    """Constants file with new declarations inserted before its first constant (SNK-04).

    ``lines(path, line_no, line)`` is the constants file, ``decls(path, key,
    declaration)`` the declarations to add to each file, ``first_line_no(path,
    first_line_no)`` the topmost constant per file (``first_constants``).
    Returns ``(path, pos, sub, key, line)`` where ``(pos, sub, key)`` orders the
    output lines: the file is never gathered into one row, so a constants file
    with millions of keys stays spread over tasks; write it with
    ``write_ordered_lines``.
    """
    old = lines.select(path_col, F.col("line_no").alias("pos"), F.lit(1).alias("sub"),
                       F.lit("").alias("key"), "line")
    new = (decls.join(first_line_no, path_col)
                .select(path_col, F.col("first_line_no").alias("pos"), F.lit(0).alias("sub"),
                        "key", F.col("declaration").alias("line")))
    return old.unionByName(new)


def write_ordered_lines(ordered: DataFrame, path: str, path_col: str = "path") -> None:
    """Write ``(path, pos, sub, key, line)`` rows as text, one folder per source path, in order.

    Range partitioning on the ordering keys keeps every part sorted and
    disjoint; reading a folder's parts in name order gives the file.
    """
    keys = [path_col, "pos", "sub", "key"]
    (ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .select(path_col, "line").write.mode("overwrite").partitionBy(path_col).text(path))
