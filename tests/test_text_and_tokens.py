import io
import random
import time
import tokenize

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vetloom.functions import text as fn
from vetloom.operators import tokens as op
from vetloom.operators.files import fill_author, parse_metadata
from vetloom.operators.tokens import canonicalize_identifiers, fix_length, lexical_tokens, word_tokens
from vetloom.operators.windows import char_windows, token_windows


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "code, expected",
    [
        ("a = '''x\ny''' + 1 # c\nb", "a =  + 1 \nb"),
        ('a = """x""" \nb = "#1"', 'a =  \nb = "'),
        ("'''open\nx # y", "'''open\nx "),
        ("\"\"\"a ''' b\"\"\" '''c", "\"\"\"a c"),
    ],
)
def test_strip_comments(spark, code, expected):
    assert one(spark, code, fn.strip_comments) == expected


def test_normalize_and_clean(spark):
    assert one(spark, "\ta\r\nb\rc", fn.normalize_code) == "    a\nb\nc"
    assert one(spark, None, fn.clean_code_text) == ""
    assert one(spark, "a\x00b", fn.clean_code_text) == "a b"
    assert one(spark, "abcdef", lambda c: fn.clean_code_text(c, cap=3)) == "abc"


@pytest.mark.parametrize(
    "text, entropy", [("", 0.0), ("aaaa", 0.0), ("ab", 1.0), ("aabb", 1.0), ("éabc", 2.0)]
)
def test_entropy(spark, text, entropy):
    assert one(spark, text, fn.shannon_entropy) == pytest.approx(entropy, abs=1e-12)


def test_versions(spark):
    for text, valid in [("1.2.3", True), (" 1.2.3\n", True), ("1.2", False), ("1.2.3a", False),
                        (None, False)]:
        assert one(spark, text, fn.is_valid_version) is valid


def test_metadata(spark):
    text = ("Name: x\r\nSUMMARY: a: b\nno colon\nAuthor:\nAuthor-email: Jo Doe <jo@x.org>\n"
            "Version: 1\nversion: 2\nLicense: MIT\n")
    df = spark.createDataFrame([(1, text), (2, ""), (3, "nothing here"),
                                (4, "Maintainer: M\nMaintainer-email: m@x.org")],
                               "id int, text string")
    rows = {r["id"]: r.asDict() for r in fill_author(parse_metadata(df)).collect()}
    assert set(rows) == {1, 4}
    assert rows[1]["author"] == "Jo Doe" and rows[1]["author-email"] == "jo@x.org"
    assert rows[1]["summary"] == "a: b" and rows[1]["version"] == "2"
    assert rows[4]["author"] == "M" and rows[4]["author-email"] == "m@x.org"


def test_word_tokens(spark):
    assert one(spark, "def école_1(x): return x+2", word_tokens) == [
        "def", "école_1", "x", "return", "x", "2"
    ]


def test_char_windows(spark):
    texts = {n: "".join(chr(97 + i % 23) for i in range(n - 1)) + ("é" if n else "")
             for n in (0, 1, 511, 512, 513, 896, 897, 961, 5000)}
    df = spark.createDataFrame(list(texts.items()), "file_id int, content string")
    rows = char_windows(df).orderBy("file_id", "chunk_idx").collect()
    for n, text in texts.items():
        mine = [r for r in rows if r["file_id"] == n]
        starts = [0] if n <= 512 else list(range(0, n, 448))
        assert [r["text"] for r in mine] == [text[s:s + 512] for s in starts]
        assert {r["n_chunks"] for r in mine} == {len(starts)}


def test_char_windows_any_overlap(spark):
    text = "".join(chr(0x1F600 + i % 50) for i in range(97))
    df = spark.createDataFrame([(1, text)], "file_id int, content string")
    for size, overlap in ((10, 3), (10, 8), (10, 0), (10, 5)):
        got = [r["text"] for r in char_windows(df, size, overlap).orderBy("chunk_idx").collect()]
        assert got == [text[s:s + size] for s in range(0, 97, size - overlap)]


def test_token_windows(spark):
    sizes = (0, 1, 9, 10, 11, 17, 18, 30)
    df = spark.createDataFrame([(n, list(map(str, range(n)))) for n in sizes],
                               "file_id int, tokens array<string>")
    for size, overlap, cap in ((10, 3, None), (10, 3, 2), (10, 10, None)):
        rows = token_windows(df, size, overlap, cap).orderBy("file_id", "chunk_idx").collect()
        for n in sizes:
            expected, start = [], 0
            while start < n:
                end = min(start + size, n)
                expected.append([str(i) for i in range(start, end)])
                if end == n:
                    break
                start = end - overlap if overlap < size else end
            got = [r["tokens"] for r in rows if r["file_id"] == n]
            assert got == (expected if cap is None else expected[:cap])


LEXED = [
    ("a = 1\nif a:\n    b()  # c\n\nd\n", "a = 1 <EOL> if a : <EOL> <INDENT> b ( ) <EOL> <DEDENT> d <EOL>"),
    ("f(1,\n   [2,\n3])\nx", "f ( 1 , [ 2 , 3 ] ) <EOL> x <EOL>"),
    ("# only\n\n   \n", ""),
    ("\n\n  a\n", "<INDENT> a <EOL> <DEDENT>"),
    ("  a\n  b", "<INDENT> a <EOL> b <EOL> <DEDENT>"),
    ('"""doc\nmore"""\nx = "s#t" + \'q\'\n', '<EOL> x = "s#t" + \'q\' <EOL>'),
    ("a **= 2.5 // b != c -> d\r\ne", "a **= 2.5 // b != c -> d <EOL> e <EOL>"),
    ("while x:\n  if y:\n    z\nw", "while x : <EOL> <INDENT> if y : <EOL> <INDENT> z <EOL> <DEDENT> <DEDENT> w <EOL>"),
    ("été = 'öpen\n", "été = ' öpen <EOL>"),
    ("if a:\n\tb\n        c\n    d\n", "if a : <EOL> <INDENT> b <EOL> c <EOL>"),  # tab to 8; 4 was never opened
    ("if a:\n    b\n  c\nd", "if a : <EOL> <INDENT> b <EOL>"),
    ("a\nf(1,\n  2\nb", "a <EOL> f ( 1 , 2 b"),
    ("if a:\n  b\n  c = '''open\nd\n", "if a : <EOL> <INDENT> b <EOL> c ="),
    ("a = 1 + \\\n  2\nb", "a = 1 + 2 <EOL> b <EOL>"),
    ("x = [\n# c\n\n  1e-5, .5, 0x1F, rb'\\'', 3.j]", "x = [ 1e-5 , .5 , 0x1F , rb'\\'' , 3.j ] <EOL>"),
    ("s = 'a\\\nb'\nt >>= ...", "s = 'a\\\nb' <EOL> t >>= ... <EOL>"),
    ("", ""),
]


def test_lexical_tokens(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(LEXED)] + [(99, None)], "file_id int, content string")
    rows = sorted(tuple(r) for r in lexical_tokens(df).collect())
    for i, (_, expected) in enumerate(LEXED):
        own = [(pos, token) for f, pos, token in rows if f == i]
        assert [t for _, t in own] == expected.split(" ") if expected else own == [], i
        assert [p for p, _ in own] == list(range(len(own)))
    assert not [r for r in rows if r[0] == 99]


def python_tokens(code):
    """What Python's own tokenizer gives for sound code, without comments, blank lines and triple-quoted texts."""
    out, names = [], {tokenize.NEWLINE: "<EOL>", tokenize.INDENT: "<INDENT>", tokenize.DEDENT: "<DEDENT>"}
    for t in tokenize.generate_tokens(io.StringIO(code).readline):
        wide = t.type == tokenize.STRING and t.string.endswith(("'''", '"""'))
        if t.type not in (tokenize.NL, tokenize.COMMENT, tokenize.ENDMARKER) and not wide:
            out.append(names.get(t.type, t.string))
    return out


def nested_code(rng, lines):
    """Sound code of random depth; blocks of any width, blank and comment lines, brackets over lines."""
    margins, out, opened = [""], [], False
    for _ in range(lines):
        if opened:
            margins.append(margins[-1] + rng.choice([" ", "  ", "    ", "\t"]))
        else:
            del margins[rng.randint(max(1, len(margins) - 3), len(margins)):]
        opened = len(margins) < 60 and rng.random() < 0.4
        out.append(margins[-1] + (rng.choice(["if a:", "for b in c :  # d", "def f(a,\n b=[1,\n\n2]):"]) if opened else rng.choice(
            ["x = 1", "y = f(1, {2: 'it\\'s'})", "'''doc'''", '"""two\n  lines"""', "z = [1,\n   # c\n 2.5e-3]", "pass", "a = b or \\\n  c"])))
        out += rng.choice([[], [], [""], ["   # note"], ["\t"]])
    return "\n".join([*out, margins[-1] + " pass" if opened else margins[-1] + "pass"]) + "\n"


def test_nested_code_has_the_tokens_of_python(spark):
    rng = random.Random(5)
    codes = [nested_code(rng, n) for n in [0, 1, 2, 3, 5, 8, 127, 128, 129, 300, 1500] * 4]
    df = spark.createDataFrame(list(enumerate(codes)), "file_id int, content string").repartition(8)
    found = {}
    for r in lexical_tokens(df).collect():
        found.setdefault(r["file_id"], []).append((r["pos"], r["token"]))
    for i, code in enumerate(codes):
        assert [t for _, t in sorted(found[i])] == python_tokens(code)
        assert max(t.count("<INDENT>") for t in [python_tokens(codes[-1])]) > 100


def test_code_operators_shuffle_nothing_and_are_linear(spark):
    long = "if x\n" * 8000 + "a = '" + "\\x41" * 20_000 + "'\n" + "(" * 3000 + "\n" * 20_000
    names = " ".join(f"n{i} n{i // 2}" for i in range(20_000))
    df = spark.createDataFrame([(1, long), (2, names)], "file_id int, content string")
    start = time.time()
    rows = {r["file_id"]: r["code"] for r in canonicalize_identifiers(df).collect()}
    assert rows[2].split()[:6] == ["a1", "a1", "a2", "a1", "a3", "a2"] and rows[2].split()[-2:] == ["a20000", "a10000"]
    assert rows[1].startswith("if a1 if a1") and "cond" not in rows[1]
    tokens = lexical_tokens(df)
    assert tokens.filter("file_id = 1").count() == 8000 * 3 + 2 + 1 + 1 + 3000
    assert time.time() - start < 30
    for frame in (tokens, canonicalize_identifiers(df)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


RENAMED = [
    ("Foo = BAR(foo)\nif Foo > 1 and x:\n  y = foo\nfor i in z: pass", "a1 = a2(a1) if cond1: a3 = a1 for cond2: pass"),
    ("x = None", "a1 = none"),
    ("condition = conda + b", "condition = conda + a1"),
    ("if a:if b:x", "if cond1:if cond2:a1"),
    ("notif a: b", "a1 a2: a3"),
    ("é1 1a _b\t=  b_", "é1 1a a1 = a2"),
    ("while x", "while a1"),
    ("", ""),
    ("...", "..."),
]


def test_canonicalize_identifiers(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(RENAMED)] + [(99, None)], "file_id int, content string")
    found = {r.file_id: r.code for r in canonicalize_identifiers(df).collect()}
    assert found == {i: e for i, (_, e) in enumerate(RENAMED)}
    legacy = {r.file_id: r.code for r in canonicalize_identifiers(df, legacy=True).collect()}
    assert legacy[1] == "a1 = a2" and legacy[0] == found[0]


def test_fix_length(spark):
    tokens = spark.createDataFrame(
        [(1, i, t) for i, t in enumerate("xaybzcaa")] + [(2, 0, "q")],
        "file_id int, pos int, token string",
    )
    vectors = spark.createDataFrame(
        [(t, [float(i + 1)] * 2) for i, t in enumerate("abc")], "token string, vector array<float>"
    )
    drop = {r["file_id"]: r for r in fix_length(tokens, vectors, 4, "drop", 2).collect()}
    assert [v[0] for v in drop[1]["sequence"]] == [1.0, 2.0, 3.0, 1.0]
    assert 2 not in drop  # nothing known: the error ladder reports it
    zero = {r["file_id"]: r for r in fix_length(tokens, vectors, 4, "zero", 2).collect()}
    assert [v[0] for v in zero[1]["sequence"]] == [0.0, 1.0, 0.0, 2.0]
    assert [v[0] for v in zero[2]["sequence"]] == [0.0, 0.0, 0.0, 0.0]


def test_fix_length_keeps_files_without_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, "a"), (2, 0, "q")], "file_id int, pos int, token string")
    files = spark.createDataFrame([(1,), (2,), (3,)], "file_id int")
    vectors = spark.createDataFrame([("a", [1.0, 1.0])], "token string, vector array<float>")
    for oov, known in (("drop", [1, 0, 0]), ("zero", [1, 1, 0])):
        out = fix_length(tokens, vectors, 2, oov, 2, files=files).orderBy("file_id").collect()
        assert [r["n_known"] for r in out] == known
        assert [r["status"] for r in out] == ["OK" if n else "Error" for n in known]
        assert out[2]["sequence"] == [[0.0, 0.0]] * 2


def odd_tokens(spark):
    """Known, unknown and null tokens, a file id of two files, and a token that has two vectors or a null one."""
    words = ["a", "b", "c", None, "x", "a", "y", "z", "twice", "none"]
    given = [(f, p, words[(p * 7 + (f or 0)) % len(words)]) for f in (1, 2, 2, 3, None) for p in range(25)]
    vectors = [("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("twice", [5.0, 6.0]), ("twice", [7.0, 8.0]), ("none", None), (None, [9.0, 9.0]), ("far", [0.5, 0.5])]
    return (spark.createDataFrame(given, "file_id int, pos int, token string"),
            spark.createDataFrame(vectors, "token string, vector array<float>"), given, vectors)


@pytest.mark.parametrize("oov", ["drop", "zero"])
def test_unknown_tokens_are_told_before_they_move(spark, oov):
    tokens, vectors, given, table = odd_tokens(spark)
    out = op.embed_tokens(tokens, vectors, oov, 2)
    expected = [(f, p, t, v or [0.0, 0.0]) for f, p, t in given for k, v in table if t is not None and t == k]
    if oov == "zero":
        expected += [(f, p, t, [0.0, 0.0]) for f, p, t in given if t is None or t not in [k for k, _ in table]]
    assert sorted(map(str, (tuple(r) for r in out.select("file_id", "pos", "token", "vector").collect()))) == sorted(map(str, expected))
    assert "bit_get" in out._jdf.queryExecution().executedPlan().toString()


def test_the_filter_of_known_tokens_loses_none(spark):
    vectors = spark.range(50_000).selectExpr("concat('k', id) AS token")
    words = vectors.union(spark.range(50_000).selectExpr("concat('u', id)"))
    passed = words.filter(op.maybe_known(vectors)).selectExpr("count_if(token LIKE 'k%') AS k", "count_if(token LIKE 'u%') AS u").first()
    assert passed.k == 50_000 and passed.u < 1_000


@pytest.mark.parametrize("n", [4, 100])
def test_a_file_gets_a_vector_once_for_all_places(spark, n, monkeypatch):
    tokens, vectors, given, table = odd_tokens(spark)
    moved, embed = [], op.embed_tokens
    monkeypatch.setattr(op, "embed_tokens", lambda rows, *more: moved.append(rows) or embed(rows, *more))
    tokens, given = tokens.filter("file_id <> 2"), [g for g in given if g[0] in (1, 3)]
    found = {r.file_id: (r.n_known, r.sequence) for r in op.fix_length(tokens, vectors, n, "drop", 2).collect()}
    expected = {}
    for f in (1, 3):
        known = [(p, t) for g, p, t in given if g == f and t in ("a", "b", "twice", "none")][:n]
        seq = [v for _, v in sorted(((p, v or [0.0, 0.0]) for p, t in known for k, v in table if k == t))]
        expected[f] = (len(seq), seq + [[0.0, 0.0]] * (n - len(seq)))
    assert found == expected
    rows, = moved
    assert rows.count() == rows.select("file_id", "token").distinct().count()
