"""Tokens, vocabularies and embedded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PYTHON_KEYWORDS
from ..functions.text import lower_flatten
from ..functions.vectors import dot, norm, zeros
from . import word2vec
from .skew import salted_join

WORD = r"[\p{L}\p{N}_]+"
_PREFIX = "[rRbBuUfF]{0,2}"
#: Comment; triple-quoted text, also one that nothing closes; string, which goes on after a backslash; number;
#: word; line end with the next margin; joined line; operator; any other. Strings are matched without giving
#: back (``*+``), which changes no match and keeps long ones off the stack.
LEXEME = (
    r"#[^\r\n]*"
    rf"|{_PREFIX}(?s:'''.*?'''|\"\"\".*?\"\"\"|'''.*|\"\"\".*)"
    rf"|{_PREFIX}(?:'(?:\\(?s:.)|[^\n'\\])*+'|\"(?:\\(?s:.)|[^\n\"\\])*+\")"
    r"|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)[eE][-+]?[0-9]+[jJ]?|[0-9][0-9_]*\.[0-9_]*[jJ]?|\.[0-9][0-9_]*[jJ]?"
    r"|[\p{L}\p{N}_]+|\r?\n[ \t\f]*|\\\r?\n"
    r"|\*\*=?|//=?|>>=?|<<=?|[-+*/%&|^=<>!:@]=|->|\.\.\.|[^\x09-\x0D\x20]"
)
WIDE = rf"^{_PREFIX}(?:'''|\"\"\")"
#: A part of code without a colon from the keyword whose condition it is.
CONDITION = r"(?s)(?<![\p{L}\p{N}_])(if|while|for)[\x09-\x0D\x20]+.+$"
#: Elements that one step of a fold goes through, so that its result is copied in short pieces.
FOLDED = 128
#: 64-bit words of the filter that tells tokens without a vector before their rows move: 1 MB, whatever the vocabulary.
FILTER_WORDS = 1 << 17
_BROKEN = -(1 << 30)


def word_tokens(col: Column) -> Column:
    """Maximal runs of Unicode letters, digits and underscores, in order."""
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def _once(x: Column) -> Column:
    """``x``, worked out once a row: an expression that could differ between two evaluations (this one never
    does) is not copied by the optimizer into the functions that use it for every element."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def _folded(df: DataFrame, values: str, out: str, state: Column, enter, step) -> DataFrame:
    """Add ``out``: what ``step`` makes of the elements of ``values`` one after the other, as integers.

    ``step(state, element)`` is a struct of the next ``state`` and ``out``. A fold that appends to its
    result copies it every time, so the array is cut into short parts; ``enter(state, part)`` is the
    state behind a part, worked out without its results.
    """
    def entered(acc, part):
        return F.struct(
            enter(acc["state"], part).alias("state"),
            F.concat(acc["starts"], F.array(acc["state"])).alias("starts"),
        )

    def folded(part, start):
        def appended(acc, x):
            found = step(acc["state"], x)
            return F.struct(found["state"].alias("state"), F.concat(acc["out"], F.array(found["out"])).alias("out"))

        return F.aggregate(part, F.struct(start.alias("state"), empty.alias("out")), appended)["out"]

    empty, nothing = F.array().cast("array<int>"), F.slice(F.array(state), 1, 0)
    number = F.floor((F.size(values) + FOLDED - 1) / FOLDED).cast("int")
    cut = lambda i: F.slice(values, i * FOLDED + 1, F.lit(FOLDED))
    parts = F.when(number > 0, F.transform(F.sequence(F.lit(0), number - 1), cut)).otherwise(F.slice(F.array(F.col(values)), 1, 0))
    starts = F.aggregate("_parts", F.struct(state.alias("state"), nothing.alias("starts")), entered)["starts"]
    df = df.withColumn("_parts", _once(parts)).withColumn("_starts", _once(starts))
    return df.withColumn(out, _once(F.flatten(F.zip_with("_parts", "_starts", folded)))).drop("_parts", "_starts")


def running_sum(df: DataFrame, values: str, out: str) -> DataFrame:
    """Add the sums of an integer array up to each element."""
    return _folded(
        df, values, out,
        F.lit(0),
        lambda state, part: F.aggregate(part, state, lambda acc, x: acc + x),
        lambda state, x: F.struct((state + x).alias("state"), (state + x).alias("out")),
    )


def indentation(df: DataFrame, margins: str, out: str) -> DataFrame:
    """Add 1 where a line opens a level, -n where it closes n, 0 elsewhere, ``_BROKEN`` at a margin that is not open.

    ``margins`` are the widths before lines that begin a statement, null for others. The open margins
    are a stack, strictly rising. Behind a part it is what lay below the part's smallest margin, and
    then the margins of the part that nothing smaller or equal follows.
    """

    def enter(stack, part):
        known = F.filter(part, lambda w: w.isNotNull())
        behind = F.aggregate(
            F.reverse(known), F.array().cast("array<int>"),
            lambda acc, w: F.when((F.size(acc) == 0) | (w < F.get(acc, F.lit(0))), F.concat(F.array(w), acc)).otherwise(acc),
        )
        least = F.array_min(part)
        return F.when(least.isNull(), stack).otherwise(F.concat(F.filter(stack, lambda s: s < least), behind))

    def step(stack, w):
        kept = F.filter(stack, lambda s: s <= w)
        closed = F.when(F.element_at(kept, -1) == w, F.size(kept) - F.size(stack)).otherwise(_BROKEN)
        return (
            F.when(w.isNull() | (w == F.element_at(stack, -1)), F.struct(stack.alias("state"), F.lit(0).alias("out")))
            .when(w > F.element_at(stack, -1), F.struct(F.concat(stack, F.array(w)).alias("state"), F.lit(1).alias("out")))
            .otherwise(F.struct(kept.alias("state"), closed.alias("out")))
        )

    return _folded(df, margins, out, F.array(F.lit(0)), enter, step)


def lexical_tokens(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """``(key, pos, token)``: code tokens with ``<EOL>``, ``<INDENT>`` and ``<DEDENT>``, positions from 0.

    Comments, blank lines and triple-quoted texts are left out. A statement ends at a line end outside
    all brackets. A line that begins one is compared with the open margins (a tab goes on to the next
    multiple of 8): a deeper one is an ``<INDENT>``, and each level that a line or the end of the code
    closes is a ``<DEDENT>``. Broken code yields what comes before the fault: a margin that was never
    opened, brackets or triple quotes that nothing closes. ``key`` names the files; null code has no row.

    All is worked out in the file's row, in time linear in its length; nothing is shuffled.
    """
    is_end = lambda t: F.ascii(t).isin(10, 13)
    dropped = lambda t: t.startswith("#") | t.rlike(r"^\\\r?\n")
    code = F.concat(F.lit("\n"), content, F.lit("\n"))
    lexemes = F.filter(F.regexp_extract_all(code, F.lit(LEXEME), F.lit(0)), lambda t: ~dropped(t))
    rows = df.filter(F.col(content).isNotNull()).select(key, _once(lexemes).alias("all"))
    # Of line ends in a row the last one has the margin of the line that follows.
    after = lambda i: F.coalesce(F.get(F.col("all"), i + 1), F.lit(""))
    rows = rows.select(key, _once(F.filter("all", lambda t, i: ~is_end(t) | ~is_end(after(i)))).alias("all"))
    places = F.filter(F.transform("all", lambda t, i: F.when(is_end(t), i)), lambda i: i.isNotNull())
    rows = rows.select(key, "all", _once(places).alias("ends"), is_end(F.element_at("all", -1)).alias("whole"))
    # A line is what stands between two line ends, or behind the last one where triple quotes stay open.
    rows = rows.withColumn("n", F.size("ends") - F.col("whole").cast("int")).filter("n > 0")
    end = lambda i: F.get(F.col("ends"), i)
    count = F.sequence(F.lit(0), F.col("n") - 1)
    line = lambda i: F.slice("all", end(i) + 2, F.coalesce(end(i + 1), F.size("all")) - end(i) - 1)
    rows = rows.withColumn("lines", _once(F.transform(count, line)))
    among = lambda x, marks: F.size(F.filter(x, lambda t: t.isin(*marks)))
    opened = F.transform("lines", lambda x: among(x, "([{") - among(x, ")]}"))
    rows = running_sum(rows.withColumn("opened", _once(opened)), "opened", "depth")
    outside = lambda i: F.get(F.col("depth"), i) <= 0
    margin = lambda i: F.regexp_replace(F.get(F.col("all"), end(i)), r"[\r\n\f]", "")
    unit = r" {0,7}\t| {8}"
    width = lambda m: 8 * F.size(F.regexp_extract_all(m, F.lit(unit), F.lit(0))) + F.length(F.regexp_replace(m, unit, ""))
    margins = F.transform(count, lambda i: F.when((i == 0) | outside(i - 1), width(margin(i))))
    rows = indentation(rows.withColumn("margins", _once(margins)), "margins", "marks")
    fault = F.array_position("marks", F.lit(_BROKEN))
    rows = rows.withColumn("good", F.when(fault > 0, fault - 1).otherwise(F.col("n")).cast("int"))
    empty = F.array().cast("array<string>")

    def told(tokens, i):
        mark = F.get(F.col("marks"), i)
        return F.concat(
            F.when(mark > 0, F.array(F.lit("<INDENT>"))).otherwise(F.array_repeat(F.lit("<DEDENT>"), F.greatest(-mark, F.lit(0)))),
            F.filter(tokens, lambda t: ~t.rlike(WIDE)),
            F.when(outside(i) & end(i + 1).isNotNull(), F.array(F.lit("<EOL>"))).otherwise(empty),
        )

    parts = F.flatten(F.transform(F.slice("lines", 1, F.col("good")), told))
    sound = (F.col("good") == F.col("n")) & F.col("whole") & (F.element_at("depth", -1) <= 0)
    levels = F.aggregate("marks", F.lit(0), lambda acc, x: acc + x)
    last = F.when(sound, F.array_repeat(F.lit("<DEDENT>"), levels)).otherwise(empty)
    return rows.select(key, F.posexplode(F.concat(parts, last)).alias("pos", "token"))


def explode_tokens(df: DataFrame, tokens: str = "tokens", key: str = "file_id") -> DataFrame:
    """``(key, pos, token)`` with positions from 0."""
    rows = df.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    return rows.filter("pos IS NOT NULL")


def vocabulary(df: DataFrame, min_count: int = 10, tokens: str = "tokens") -> DataFrame:
    """Token counts from ``min_count`` on; counts combine map-side before the shuffle."""
    rows = df.select(F.explode_outer(tokens).alias("token")).filter("token IS NOT NULL")
    return rows.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def train_word2vec(
    df: DataFrame,
    tokens: str = "tokens",
    size: int = 100,
    min_count: int = 10,
    epochs: int = 6,
    window: int = 5,
    partitions: int | None = None,
    seed: int = 42,
) -> word2vec.TokenVectors:
    """Vectors of ``size``; the rows are trained in ``partitions`` tasks, by default one per input partition.

    Skip-gram with hierarchical softmax, as Spark's estimator does it, but no vector comes to the driver.
    """
    if partitions is None:
        partitions = max(1, df.rdd.getNumPartitions())
    else:
        df = df.repartition(partitions)
    rows = df.select(F.col(tokens).alias("tokens"))
    return word2vec.fit(rows, lambda told: vocabulary(told, min_count), partitions, size, epochs, window, seed)


def model_vectors(model: word2vec.TokenVectors) -> DataFrame:
    """Vocabulary vectors of a fitted model as ``(token, vector)``."""
    return model.getVectors().select(F.col("word").alias("token"), "vector")


def similar_tokens(vectors: DataFrame, word: str, n: int = 5) -> DataFrame:
    """The ``n`` nearest other tokens by cosine; none for a word outside the vocabulary.

    The query vector is a scalar subquery, and only the ``n`` best rows of each task are kept.
    """
    query = vectors.filter(F.col("token") == word).select("vector").scalar()
    similarity = F.try_divide(
        dot(F.col("vector"), F.col("_query")), norm(F.col("vector")) * norm(F.col("_query"))
    )
    return (
        vectors.filter(F.col("token") != word)
        .withColumn("_query", query)
        .select("token", similarity.alias("similarity"))
        .filter("similarity IS NOT NULL")
        .orderBy(F.desc("similarity"), "token")
        .limit(n)
    )


def _sampled(tokens: DataFrame, key: str) -> DataFrame:
    """The tokens of one file in sixteen: enough to tell the hot tokens, and filtered before texts are split."""
    return tokens.filter(F.pmod(F.xxhash64(key), F.lit(16)) == 0)


def maybe_known(vectors: DataFrame) -> Column:
    """Whether the column ``token`` may be one of ``vectors``; false only for tokens that have none.

    Every known token sets one bit of a filter, a scalar subquery of fixed size. The larger the vocabulary,
    the more unknown tokens pass, and the join behind drops them; a token that has a vector always passes.
    """
    h = F.xxhash64("token")
    word, bit = F.pmod(h, F.lit(FILTER_WORDS)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")
    known = vectors.filter("token IS NOT NULL").select(word.alias("word"), bit.alias("bit"))
    every = vectors.sparkSession.range(FILTER_WORDS).selectExpr("cast(id AS int) AS word", "0L AS bits")
    words = known.selectExpr("word", "shiftleft(1L, bit) AS bits").union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits")).scalar()
    return F.col("token").isNotNull() & (F.bit_get(F.get(bits, word), bit) == 1)


def embed_tokens(
    tokens: DataFrame, vectors: DataFrame, oov: str = "drop", dim: int = 100, key: str = "file_id"
) -> DataFrame:
    """``(file_id, pos, token, vector)``; unknown tokens are dropped or get zeros.

    Word counts are Zipf-shaped, so one token can be a large share of the rows. The rows of the tokens
    that are hot among one file in sixteen (by hash of ``key``) are spread by position; only their vectors are
    repeated. Where the vocabulary is small enough Spark broadcasts it instead. Most tokens without a vector
    are told where they lie (``maybe_known``) and never move.
    """
    if oov not in ("drop", "zero"):
        raise ValueError(f"unknown rule for unknown tokens: {oov}")
    known = maybe_known(vectors)
    likely = tokens.filter(known)
    how = "inner" if oov == "drop" else "left"
    out = salted_join(likely, vectors, "token", how, by=["pos"], measured=_sampled(likely, key))
    if oov == "zero":
        out = out.unionByName(tokens.filter(~known), allowMissingColumns=True)
    return out.withColumn("vector", F.coalesce("vector", zeros(dim)))


def fix_length(
    tokens: DataFrame,
    vectors: DataFrame,
    n: int = 100,
    oov: str = "drop",
    dim: int = 100,
    key: str = "file_id",
    files: DataFrame | None = None,
) -> DataFrame:
    """First ``n`` vectors of every file, zero-padded: ``(key, n_known, sequence)``.

    With ``files``, a table that holds every key once, files without a sequence are kept: their
    ``n_known`` is 0, their sequence all zeros and their ``status`` ``Error`` (else ``OK``). Without it
    only files that have tokens to keep can be told.

    With ``zero`` the position filter runs before the vector join. With ``drop`` positions are
    ranked again among known tokens, and Spark keeps at most ``n`` rows per file and task before
    the shuffle, so a huge file does not arrive in one task. Tokens that cannot be known stay where they
    lie, and a file is sent a vector once for all places of its token.
    """
    if oov == "zero":
        kept = embed_tokens(tokens.filter(F.col("pos") < n), vectors, "zero", dim, key)
        pairs = F.collect_list(F.struct("pos", "vector"))
    else:
        likely = tokens.filter(maybe_known(vectors))
        known = salted_join(likely, vectors.select("token"), "token", "left_semi", by=["pos"], measured=_sampled(likely, key))
        order = Window.partitionBy(key).orderBy("pos")
        first = known.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
        places = first.groupBy(key, "token").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
        kept = embed_tokens(places, vectors, "drop", dim, key)
        at = lambda x: F.transform(x["pos"], lambda p: F.struct(p.alias("pos"), x["vector"].alias("vector")))
        pairs = F.flatten(F.transform(F.collect_list(F.struct("pos", "vector")), at))
    rows = kept.groupBy(key).agg(F.array_sort(pairs)["vector"].alias("seq"))
    padding = F.array_repeat(zeros(dim), n - F.size("seq"))
    told = rows.select(
        key, F.size("seq").alias("n_known"), F.concat("seq", padding).alias("sequence")
    )
    if files is None:
        return told
    empty = F.array_repeat(zeros(dim), n)
    return files.select(key).join(told, key, "left").select(
        key,
        F.coalesce("n_known", F.lit(0)).alias("n_known"),
        F.coalesce("sequence", empty).alias("sequence"),
        F.when(F.col("n_known").isNull(), "Error").otherwise("OK").alias("status"),
    )


def first_appearance_rank(df: DataFrame, tokens: str = "tokens", key: str = "file_id") -> DataFrame:
    """``(key, token, appearance)``: distinct tokens of a file, numbered by first position.

    The order of first appearance is what ``array_distinct`` keeps, so the file's row is handled
    in place.
    """
    ranked = df.select(key, F.posexplode_outer(F.array_distinct(tokens)).alias("_i", "token"))
    return ranked.filter("_i IS NOT NULL").select(key, "token", (F.col("_i") + 1).alias("appearance"))


def canonicalize_identifiers(
    df: DataFrame, content: str = "content", key: str = "file_id", legacy: bool = False
) -> DataFrame:
    """``(key, code)``: lower-cased code with numbered conditions and renamed identifiers, single-spaced.

    The n-th condition after ``if``, ``while`` or ``for`` becomes ``condn``. Words of ASCII letters,
    digits and underscores that are no keyword and do not begin with ``cond`` are named ``a1``, ``a2``,
    ... by their first position in the file, within the file's own row; nothing is shuffled. With
    ``legacy`` capitalised keywords do not match lower-cased code and are renamed too. ``key`` tells
    the files apart; null code has no row.
    """
    lower = df.filter(F.col(content).isNotNull()).select(key, _once(F.split(F.lower(content), ":")).alias("parts"))
    # A condition ends at the next colon, so each part between colons has at most one. Colons are
    # written as ":0", those behind a condition as ":1", which nothing else can look like.
    last = F.size("parts") - 1
    begun = lambda p: F.concat(F.regexp_replace(p, CONDITION, "$1 "), F.lit(":1"))
    written = F.transform("parts", lambda p, i: F.when(i == last, p).when(p.rlike(CONDITION), begun(p)).otherwise(F.concat(p, F.lit(":0"))))
    marked = lower.select(key, _once(F.split(F.array_join(written, ""), ":1")).alias("parts"))
    numbered = F.transform("parts", lambda p, i: F.when(i == last, p).otherwise(F.concat(p, F.lit("cond"), i + 1, F.lit(":"))))
    plain = F.replace(F.array_join(numbered, ""), F.lit(":0"), F.lit(":"))
    flat = marked.select(key, _once(F.trim(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))).alias("code"))
    split = flat.select(key, _once(F.split("code", WORD)).alias("gaps"), _once(F.regexp_extract_all("code", F.lit(WORD), F.lit(0))).alias("words"))
    keywords = [w if legacy else w.lower() for w in PYTHON_KEYWORDS]
    renamed = lambda w: w.rlike("^[a-z_][a-z0-9_]*$") & ~w.startswith("cond") & ~w.isin(keywords)
    names = split.withColumn("names", _once(F.array_distinct(F.filter("words", renamed))))
    # The names lie in maps of about 64, or as many maps as a map has entries, so that looking one up is short in any file.
    names = names.withColumn("maps", _once(F.greatest(F.least(F.ceil(F.size("names") / 64), F.ceil(F.sqrt(F.size("names")))), F.lit(1)).cast("int")))
    place = lambda w: F.pmod(F.hash(w), F.col("maps"))
    entry = lambda w, i: F.struct(w.alias("word"), F.concat(F.lit("a"), i + 1).alias("name"))
    names = names.withColumn("entries", _once(F.transform("names", entry)))
    own = lambda m: F.map_from_entries(F.filter("entries", lambda e: place(e["word"]) == m))
    names = names.withColumn("by_hash", _once(F.transform(F.sequence(F.lit(0), F.col("maps") - 1), own)))
    said = F.transform("words", lambda w: F.coalesce(F.try_element_at(F.get(F.col("by_hash"), place(w)), w), w))
    pieces = F.zip_with("gaps", said, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))
    return names.select(key, F.array_join(pieces, "").alias("code"))


def corpus_stats(df: DataFrame, text: str = "content") -> DataFrame:
    """Characters and blanks of the flattened corpus."""
    flat = lower_flatten(F.col(text))
    return df.agg(
        F.sum(F.length(flat)).alias("n_chars"),
        F.sum(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))).alias("n_spaces"),
    )


def sentences(df: DataFrame, text: str = "content", key: str = "file_id") -> DataFrame:
    """``(key, sentence_idx, words)``; punctuation is not kept."""
    return df.select(
        key, F.posexplode(F.sentences(F.col(text))).alias("sentence_idx", "words")
    )
