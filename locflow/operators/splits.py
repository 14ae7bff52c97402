"""Tokens of files too large for one task (SRC-05, EXT-01): every split works at once.

A file is read by lines, by as many tasks as it has splits, and lines are put
together to chunks of ``chunk_lines`` lines inside their split. A line can
begin in three states only: in code, in a block comment, or in a verbatim
literal; the other tokens end with their line.

1. Each chunk is tokenised as if it began in code; its tokens and what stands
   between them are kept in place of its text. For every state that it may
   begin in it finds the state it ends in, how many tokens it holds and how
   many openers are left over. The runs from the other states need the text
   only up to a line break where they have met the run from code.
2. The states are composed along the file: within groups of ``GROUP`` chunks,
   then over the groups, so a chunk learns the state it really begins in from
   two short scans and no text.
3. Each chunk emits its tokens under that state; only a chunk that does not
   begin in code is tokenised again. A token that goes on over chunks is
   emitted in pieces, which meet by its number in the file.

Ordinals, offsets and lines are prefix sums over chunks, tiny rows. Tokens,
ordinals and positions equal those of ``extract_literals`` on the whole file,
whatever the splits. A single line has to fit a row, and so does a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locflow.functions import text as T
from locflow.functions.tokens import CODE_TOKEN, DIRECTIVE, LITERALS, LOOKUP_PREFIXES
from locflow.operators.extract import openers_in
from locflow.session import stage
from locflow.sources import scan
from locflow.sources.files import few_tasks

CHUNK_LINES = 4096
GROUP = 256
CODE, BLOCK, VERBATIM = 0, 1, 2

# What may stand at a chunk's ends besides whole tokens: an opener that the chunk does not close, and the rest of what
# an earlier chunk opened, closed here or not.
_OPEN = r'/\*[\s\S]*+|(?:\$@|@\$?)"[\s\S]*+'
_REST = {BLOCK: r"\A(?:[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|[\s\S]*+)", VERBATIM: r'\A(?:[^"]*+(?:""[^"]*+)*+"|[\s\S]*+)'}
# A directive begins with a blank or ``#``, every other token and opener with one of five characters: where none of them
# stands, the alternatives are not tried.
_TOKEN = f"(?=[\"'$@/])(?:{CODE_TOKEN.removesuffix('|' + DIRECTIVE)}|{_OPEN})|{DIRECTIVE}"
PATTERNS = [_TOKEN] + [f"{_REST[s]}|{_TOKEN}" for s in (BLOCK, VERBATIM)]
MARK = "\0"
# Lines after which a run from another state is compared with the run from code.
HEADS = (8, 32, 128, 512, 2048)


def read_chunks(spark: SparkSession, path: str, glob: str = "*.cs", recursive: bool = True,
                chunk_lines: int = CHUNK_LINES, mark: str = "\n", leads: bool = False) -> DataFrame:
    """``path, split, chunk, content``: pieces of files, whole lines each with its line break.

    Another ``mark`` than the line break cuts elsewhere; with ``leads`` a mark
    stands before its record, not behind it (also before a file's first one,
    which had none). Records of a split follow each other in one task, which
    puts them together as they come, and a task holds some chunks. Files of a
    mounted folder are listed and cut by tasks (``scan``); of another store
    Spark's text source reads the records.
    """
    if scan.by_tasks(path):
        chunks = few_tasks(scan.read_pieces(spark, path, glob, recursive, mark, leads, chunk_lines))
        return chunks.select("path", "split", "chunk", F.col("content").cast("string").alias("content"))
    record = F.concat(F.lit(mark), "value") if leads else F.concat("value", F.lit(mark))
    lines = few_tasks(spark.read.option("recursiveFileLookup", "true" if recursive else "false").option("pathGlobFilter", glob)
                      .option("lineSep", mark).text(path)
                      .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), record.alias("line")))

    def put_together(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(done):
            paths, splits, chunks, texts = zip(*done)
            return pa.record_batch([pa.array(paths, pa.string()), pa.array(splits, pa.int64()), pa.array(chunks, pa.int64()),
                                    pa.array(texts, pa.binary())], ["path", "split", "chunk", "content"])

        at, chunk, held, parts = None, 0, 0, []     # the open chunk's file and split, number, lines and text so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, splits, text = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            ends = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset:text.offset + n + 1]
            data = memoryview(text.buffers()[2])
            other = (splits[1:] != splits[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(other) + 1).tolist(), n]
            done = []
            for i, j in zip(starts, starts[1:]):
                here = (files[i].as_py(), int(splits[i]))
                if here != at:
                    if held:
                        done.append((*at, chunk, b"".join(parts)))
                    at, chunk, held, parts = here, 0, 0, []
                while i < j:
                    k = min(j, i + chunk_lines - held)
                    parts.append(bytes(data[ends[i]:ends[k]]))
                    held, i = held + k - i, k
                    if held == chunk_lines:
                        done.append((*at, chunk, b"".join(parts)))
                        chunk, held, parts = chunk + 1, 0, []
            if done:
                yield rows(done)
        if held:
            yield rows([(*at, chunk, b"".join(parts))])

    chunks = lines.mapInArrow(put_together, "path string, split bigint, chunk bigint, content binary")
    return chunks.select("path", "split", "chunk", F.col("content").cast("string").alias("content"))


def entered(facts: DataFrame, states: int) -> DataFrame:
    """``facts(path, split, chunk, to)`` with ``n``, the chunk's number in its file, and the ``state`` it begins in.

    ``to`` is the state that a chunk ends in, for each that it may begin in; a file begins in state 0. The functions
    are composed within groups of ``GROUP`` chunks, then over the groups.
    """
    order = Window.partitionBy("path").orderBy("split", "chunk")
    facts = facts.withColumn("n", F.row_number().over(order)).withColumn("g", F.floor((F.col("n") - 1) / GROUP))
    groups = facts.groupBy("path", "g").agg(F.sort_array(F.collect_list(F.struct("n", "to"))).alias("c"))
    groups = groups.select("path", "g", F.aggregate("c", F.array(*map(F.lit, range(states))),
                                                    lambda at, x: F.transform(at, lambda s: x["to"][s])).alias("to"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    walk = lambda steps, start: F.aggregate(steps, start, lambda s, to: to[s])
    groups = groups.select("path", "g", walk(F.collect_list("to").over(before(Window.partitionBy("path").orderBy("g"))),
                                             F.lit(0)).alias("enter"))
    inside = F.collect_list("to").over(before(Window.partitionBy("path", "g").orderBy("n")))
    return facts.withColumn("steps", inside).join(groups, ["path", "g"]).withColumn(
        "state", walk(F.col("steps"), F.col("enter"))).drop("steps", "enter", "g")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _cut(content: Column, state: int) -> Column:
    """``struct(gaps, toks)`` of a chunk that begins in ``state``: one gap more than tokens.

    One pass puts a mark around the tokens; a chunk that holds the mark itself takes two.
    """
    pattern = F.lit(PATTERNS[state])
    parts = F.split(F.regexp_replace(content, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    dealt = _let(parts, lambda p: F.struct(F.filter(p, lambda x, i: i % 2 == 0).alias("gaps"), F.filter(p, lambda x, i: i % 2 == 1).alias("toks")))
    twice = F.struct(F.split(content, PATTERNS[state], -1).alias("gaps"), F.regexp_extract_all(content, pattern, F.lit(0)).alias("toks"))
    return F.when(F.contains(content, F.lit(MARK)), twice).otherwise(dealt)


def _joined(gaps: str, toks: str) -> Column:
    """The chunk's text."""
    return F.array_join(F.flatten(F.transform(F.arrays_zip(F.col(gaps).alias("gap"), F.col(toks).alias("tok")),
                                              lambda x: F.array(x["gap"], F.coalesce(x["tok"], F.lit(""))))), "")


def _outcome(content: Column, cut: Column, state: int) -> Column:
    """``struct(state, starts, stray)`` of a chunk that begins in ``state`` and was cut so."""
    end = F.try_element_at(cut["toks"], F.lit(-1))
    # only an unclosed token runs to the chunk's last line break
    opened = F.when(end == content, F.lit(state)) if state != CODE else F.when(F.lit(False), F.lit(state))
    after = opened.when(end.startswith("/*"), F.lit(BLOCK)).otherwise(F.lit(VERBATIM))
    return F.struct(F.when(end.endswith("\n"), after).otherwise(F.lit(CODE)).alias("state"),
                    (F.size(cut["toks"]).cast("bigint") - (1 if state != CODE else 0)).alias("starts"),
                    _let(F.array_join(cut["gaps"], "\n"), lambda t: openers_in(t)).alias("stray"))


def _run(content: Column, state: int) -> Column:
    return _let(_cut(content, state), lambda cut: _outcome(content, cut, state))


def _other(content: Column, lines: Column, state: int, code: Column, heads=HEADS) -> Column:
    """The outcome from another ``state`` than code, whose outcome ``code`` is known.

    Where both runs are in one state at a line break, all behind it is the
    same: heads of more and more lines are tried, at last the whole chunk.
    """
    if not heads:
        return _run(content, state)
    head = F.concat(F.substring_index(content, "\n", heads[0]), F.lit("\n"))
    both = F.when(lines > heads[0], _let(head, lambda h: F.struct(_run(h, state).alias("own"), _run(h, CODE).alias("code"))))
    rest = lambda b, k: (b["own"][k] + code[k] - b["code"][k]).alias(k)
    return _let(both, lambda b: F.when(b["own"]["state"] == b["code"]["state"],
                                       F.struct(code["state"].alias("state"), rest(b, "starts"), rest(b, "stray")))
                .otherwise(_other(content, lines, state, code, heads[1:])))


def cut_chunks(chunks: DataFrame) -> DataFrame:
    """``path, split, chunk, gaps, toks, f, chars, lines`` per chunk: cut as from code, and its outcome ``f`` from each state."""
    c, lines = F.col("content"), F.col("lines")
    cut = chunks.select("path", "split", "chunk", "content", _cut(c, CODE).alias("cut"), T.newlines(c).cast("bigint").alias("lines"))
    from_code = cut.withColumn("code", _let(F.col("cut"), lambda x: _outcome(c, x, CODE)))
    others = [_other(c, lines, s, F.col("code")) for s in (BLOCK, VERBATIM)]
    return from_code.select("path", "split", "chunk", F.col("cut.gaps").alias("gaps"), F.col("cut.toks").alias("toks"),
                            F.array(F.col("code"), *others).alias("f"), F.length(c).cast("bigint").alias("chars"), "lines")


def begin_states(cut: DataFrame) -> DataFrame:
    """``path, split, chunk, n, state, ordinal, offset, line, chars, lines, stray, open`` per chunk: what it begins with
    and leaves over."""
    facts = cut.select("path", "split", "chunk", "f", "chars", "lines")
    known = entered(facts.withColumn("to", F.transform("f", lambda x: x["state"])), 3).withColumn("here", F.col("f")[F.col("state")])
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda e: F.coalesce(F.sum(e).over(before), F.lit(0))
    return known.select("path", "split", "chunk", "n", "state", so_far(F.col("here.starts")).alias("ordinal"),
                        so_far(F.col("chars")).alias("offset"), so_far(F.col("lines")).alias("line"), "chars", "lines",
                        F.col("here.stray").alias("stray"), F.col("here.state").alias("open"))


def _tokens(texts: DataFrame, known: DataFrame, prefixes) -> DataFrame:
    """A row per token or ``piece`` of one: what ``known`` has of its chunk, its ``pos`` there, ``raw``, ``ordinal``, ``wrapped``,
    the size of the gap ``before`` it and of the ``step`` over both, and their line breaks."""
    state = F.col("state")
    again = lambda s: _let(_joined("gaps", "toks"), lambda c: _cut(c, s))
    cut = (F.when(state == CODE, F.struct("gaps", "toks")).when(state == BLOCK, again(BLOCK)).otherwise(again(VERBATIM)))
    chunk = ("path", "n", "state", "ordinal", "offset", "line", "chars", "lines")
    c = texts.join(known.select("path", "split", "chunk", *chunk[1:]), ["path", "split", "chunk"])
    c = c.select(*chunk, F.inline(F.array(cut)).alias("gaps", "toks"))
    t = c.select(*chunk, F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("toks")).alias("gap"), F.col("toks").alias("raw"))).alias("pos", "tk"))
    gap, raw = F.col("tk.gap"), F.col("tk.raw")
    wrapped = F.lit(False)
    for p in prefixes:
        wrapped = wrapped | gap.endswith(p)
    rest = (F.col("pos") == 0) & (state != CODE)        # goes on with a token of an earlier chunk
    return t.select("path", "n", "pos", (F.col("ordinal") + F.col("pos") - F.when(state != CODE, 1).otherwise(0)).cast("bigint").alias("ordinal"),
                    raw.alias("raw"), wrapped.alias("wrapped"), (rest | raw.endswith("\n")).alias("piece"), "offset", "line", "chars", "lines",
                    F.length(gap).alias("before"), T.newlines(gap).alias("breaks"),
                    (F.length(gap) + F.length(raw)).alias("step"), (T.newlines(gap) + T.newlines(raw)).alias("step_lines"))


def split_literals(spark: SparkSession, path: str, glob: str = "*.cs", prefixes=LOOKUP_PREFIXES, recursive: bool = True,
                   chunk_lines: int = CHUNK_LINES, keep_comments: bool = False, only_balanced: bool = True):
    """``(literals, rejects)`` of large code files: the columns of ``extract_literals``, and the files set aside.

    ``rejects(stage, path, detail)`` names files with a stray opener, or with
    a block comment or verbatim literal that their end leaves open;
    ``only_balanced=False`` keeps the tokens of such files too.
    """
    cut = stage(cut_chunks(read_chunks(spark, path, glob, recursive, chunk_lines)), "chunk-tokens")
    known = stage(begin_states(cut), "chunk-states")
    files = known.groupBy("path").agg(F.sum("stray").alias("stray"), F.max_by("open", "n").alias("open"))
    bad = files.where((F.col("stray") > 0) | (F.col("open") != CODE))
    rejects = bad.select(F.lit("unbalanced").alias("stage"), "path",
                         F.concat(F.lit("stray quotes: "), (F.col("stray") + (F.col("open") != CODE).cast("bigint")).cast("string")).alias("detail"))
    if only_balanced:
        known = known.join(bad.select("path"), "path", "left_anti")
    texts = cut.select("path", "split", "chunk", "gaps", "toks")
    here = Window.partitionBy("path", "n").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda base, step, own: (F.col(base) + F.coalesce(F.sum(step).over(here), F.lit(0)) + F.col(own)).cast("bigint")
    whole = (_tokens(texts, known, prefixes)
             .withColumn("at", at("offset", "step", "before")).withColumn("at_line", at("line", "step_lines", "breaks") + 1)
             .where(~F.col("piece")).select("path", "ordinal", "raw", "wrapped", F.col("at").alias("offset"), F.col("at_line").alias("line_no")))
    # a piece stands at an end of its chunk, and few chunks have one; the first piece of a token runs to the chunk's end
    ends = known.where((F.col("state") != CODE) | (F.col("open") != CODE))
    from_end = lambda base, size, own: (F.col(base) + F.col(size) - own(F.col("raw"))).cast("bigint")
    pieces = (_tokens(texts, ends, prefixes).where("piece")
              .select("path", "n", "ordinal", "raw", "wrapped", from_end("offset", "chars", F.length).alias("offset"),
                      (from_end("line", "lines", T.newlines) + 1).alias("line_no"))
              .groupBy("path", "ordinal").agg(F.sort_array(F.collect_list(F.struct("n", "raw"))).alias("p"),
                                              F.min(F.struct("n", "wrapped", "offset", "line_no")).alias("first")))
    joined = pieces.select("path", "ordinal", F.array_join(F.transform("p", lambda x: x["raw"]), "").alias("raw"),
                           "first.wrapped", "first.offset", "first.line_no")
    out = whole.unionByName(joined).withColumn("kind", T.token_kind("raw"))
    if not keep_comments:
        out = out.where(F.col("kind").isin(*LITERALS))
    return out.select("path", "ordinal", "kind", "raw", "wrapped", T.inner_text("raw", "kind").alias("text"), "offset", "line_no"), rejects
