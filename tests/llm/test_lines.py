import random
from collections import defaultdict

from riskloom.llm import lines
from riskloom.llm.queries import QUERIES
from llm_fixtures import make_docs, small_dir, small_docs  # noqa: F401


def shingles(line):
    return {line[i:i + 5] for i in range(len(line) - 4)} if len(line) >= 5 else {line}


def brute(rows):
    """(doc_id, line_no) -> (class, kept); classes are the component's smallest line."""
    all_lines = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip(" ")})
    sets, root = [shingles(x) for x in all_lines], {x: x for x in all_lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for c in {j for k in s for j in by[k]}:
            n = len(s & sets[c])
            if n >= 0.8 * (len(s) + len(sets[c]) - n):
                a, b = sorted((find(all_lines[i]), find(all_lines[c])))
                root[b] = a
        for k in s:
            by[k].append(i)
    return {x: find(x) for x in all_lines}


def compare(rows, got):
    classes = brute(rows)
    named = defaultdict(set)
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                named[got[i, k][0]].add(x)
            else:
                assert got[i, k] == (None, True)
    expected = defaultdict(set)
    for x, c in classes.items():
        expected[c].add(x)
    kept = sum(k for c, k in got.values() if c is not None)
    return {frozenset(v) for v in expected.values()}, {frozenset(v) for v in named.values()}, kept


def result(df):
    return {(r.doc_id, r.line_no): (r.class_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark, small_dir, small_docs):
    rows = [r[:2] for r in small_docs]
    expected, got, kept = compare(rows, result(QUERIES["op3_line_dedup"](spark, small_dir)))
    assert len(got - expected) <= 0.005 * len(expected)  # banding may miss a link in a few hundred
    assert kept == len(got)


def fixture():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = sentence(60).split()
    rows = [(i, " ".join(base[:i] + ["changed%d" % i] + base[i + 1:]) + "\n" + sentence(20)) for i in range(40)]
    short = sentence(14)
    rows += [(100 + i, short[:60 + i] + "\n\n  \nshort") for i in range(3)]
    rows += [(200, None), (201, ""), (202, "abc\nabc\nabd\nab"), (203, "中" * 30 + "文" * 30), (204, "中" * 30 + "文" * 29),
             (205, "q" * 60_000), (206, "\n"), (207, sentence(3000)), (208, "Q w"), (208, "Q w")]
    return rows


def test_edge_rows(make_docs):
    rows = fixture()
    docs = make_docs(rows)
    got = result(lines.line_classes(docs))
    expected, named, kept = compare(rows, got)
    assert named == expected
    assert got[0, 0][1] and not any(got[i, 0][1] for i in range(1, 40))
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[200] is None and texts[202] == "abc\nabd\nab" and texts[0] == rows[0][1] and texts[101] == "\n  "
    assert out.count() == len(rows)


def test_members_of_mixed_buckets_are_compared(spark, make_docs, monkeypatch):
    """Everything in one bucket: links between members that the smallest member is not similar to are found."""
    monkeypatch.setattr(lines, "_bands", lambda h, kind: lines.F.array(lines.F.lit(kind).cast("long")))
    rows = [r for r in fixture() if r[0] < 10 or 100 <= r[0] < 203]
    expected, named, _ = compare(rows, result(lines.line_classes(make_docs(rows))))
    assert named == expected


def test_few_spaces_do_not_part_similar_lines(make_docs):
    """About one space in 20 characters: two more characters, or one more word, leave lines similar."""
    rng = random.Random(5)
    rows = []
    for i in range(30):
        words = ["".join(rng.choice("abcdefghij/.=&") for _ in range(19)) for _ in range(7)]
        line = " ".join(words)[:139]
        rows += [(10 * i, line), (10 * i + 1, line + "xy"), (10 * i + 2, line + " x")]
    expected, named, kept = compare(rows, result(lines.line_classes(make_docs(rows))))
    assert len(expected) == 30 and named == expected and kept == 30


def edited(line, rng, low, high):
    """``line`` with characters replaced one by one until its similarity is between ``low`` and ``high``."""
    while True:
        got, s = list(line), 1.0
        while s > high:
            got[rng.randrange(len(got))] = rng.choice("KLMNOP")
            a, b = shingles(line), shingles("".join(got))
            s = len(a & b) / len(a | b)
        if s >= low:
            return "".join(got)


def long_lines(kind, n, rng):
    """Lines of 130 to 300 characters: ordinary words, long words, or no spaces at all."""
    low, high = {"words": (2, 8), "long words": (15, 25), "no spaces": (300, 300)}[kind]
    word = lambda: "".join(rng.choice("abcdefghij/.=&") for _ in range(rng.randint(low, high)))
    return [" ".join(word() for _ in range(150))[:rng.randint(130, 300)] for _ in range(n)]


def shared(spark, pairs):
    """Of the pairs of lines, how many share a band."""
    rows = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)],
                                 "id long, line string").repartition(8)
    bands = defaultdict(set)
    for r in lines.signatures(rows).collect():
        bands[r.id].update(r.bands)
    return sum(bool(bands[2 * i] & bands[2 * i + 1]) for i in range(len(pairs)))


def test_long_lines_are_found_at_low_similarity(spark):
    """At a similarity of 0.80 twelve bands of five minima find 99 % of the pairs, and more above."""
    rng = random.Random(6)
    for kind in ("words", "long words", "no spaces"):
        for low, high in ((0.8, 0.85), (0.85, 0.9)):
            pairs = [(x, edited(x, rng, low, high)) for x in long_lines(kind, 400, rng)]
            found = shared(spark, pairs)
            print(f"recall {kind} {low}-{high}: {found} of {len(pairs)}")
            assert found >= 0.98 * len(pairs), (kind, low, found)


ENDS = [(1, "Yes.\r\n1234\r\nNo..\r\n\r\n \r\n\t\nlast"), (2, "abcd\u2028\nefgh\u2029\nijkl\x85\n\x0b\x0c\r"),
        (3, "\r\n\r\nYes.\r\n5678\r"), (4, "a\rb\rc\rd\re\rf\ng\rh\ri\rj\rk\rl"),
        (5, "😀😁😂😃😄😅😆😇😈😉\n😀😁😂😃😄😅😆😇😈x\n😐😑😒😓😔")]


def test_line_ends_are_characters(make_docs):
    """Carriage returns and Unicode line ends inside lines; lines of white space are blank."""
    got = result(lines.line_classes(make_docs(ENDS)))
    rows = [(i, "\n".join(x if x.strip(" \t\r\x0b\x0c") else "" for x in t.split("\n"))) for i, t in ENDS]
    expected, named, kept = compare(rows, got)
    assert named == expected and kept == len(expected)
    assert len(expected) == 13  # only the lines "Yes.\r" are equal
    texts = {r.doc_id: r.text for r in lines.dedup_lines(make_docs(ENDS)).collect()}
    assert texts == dict(ENDS) | {3: "\r\n\r\n5678\r"}


def test_shingles_are_all_windows(spark):
    found = [x for _, t in ENDS for x in t.split("\n") if x]
    rows = spark.createDataFrame([(x,) for x in found], "line string")
    for r in rows.select("line", lines.shingles(lines.F.col("line")).alias("s")).collect():
        assert sorted(r.s) == sorted(shingles(r.line))


def test_bands_are_the_first_hashes_from_each_start(spark):
    """However the hashes lie: evenly, all below or above a start, on it, next to it."""
    rng = random.Random(13)
    starts = [-(1 << 63) + i * ((1 << 64) // lines.BANDS) for i in range(lines.BANDS)]
    near = [x + k for x in starts[1:] for k in (-1, 0, 1)]
    sets = [{rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)} for n in (25, 26, 31, 32, 33, 100, 361, 2000)]
    sets += [set(near), set(range(-40, 0)), set(range(starts[-1] - 40, starts[-1])), set(range((1 << 63) - 50, 1 << 63)),
             set(range(-(1 << 63), 40 - (1 << 63))), {*near, *range(starts[5], starts[5] + 100)}]
    hashes = [sorted(x) for x in sets]
    rows = [(i, h, [([x for x in h if x >= s] + h)[:lines.ROWS] for s in starts]) for i, h in enumerate(hashes)]
    F = lines.F
    df = spark.createDataFrame(rows, "id int, h array<long>, firsts array<array<long>>").withColumn(
        "expected", F.transform("firsts", lambda x, i: F.xxhash64(x, F.lit(300) + i)))
    for r in df.select("id", "expected", lines._bands(F.col("h"), 3).alias("got")).collect():
        assert r.got == r.expected, r.id


def test_empty(make_docs):
    assert lines.line_classes(make_docs([])).count() == 0
    assert lines.dedup_lines(make_docs([])).count() == 0


def touched(rng, line, edits):
    """``line`` with characters appended, prepended, put in, taken out or changed."""
    for _ in range(edits):
        at, c = rng.randrange(len(line) + 1), rng.choice("abcdefghij ")
        line = rng.choice([line + c, c + line, line[:at] + c + line[at:], line[:at] + line[at + 1:],
                           line[:at] + c + line[at + 1:]])
    return line


def test_recall_of_short_lines_by_length(spark):
    """Every pair of similar lines shares a band up to FEW shingles; 0.99 of them up to 60 characters."""
    rng = random.Random(12)
    pairs = []
    for length in range(1, 61):
        made = 0
        while made < 60:
            a = "".join(rng.choice("abcdefghij ") for _ in range(length))
            b = touched(rng, a, rng.randint(1, 2))
            u, v = shingles(a), shingles(b)
            if b and a != b and len(u & v) >= 0.8 * len(u | v):
                pairs.append((a, b, max(len(u), len(v))))
            made += 1
    pairs += [("aaaaa", "a" * n, 1) for n in (6, 9, 40)] + [("abcdefgh", "abcdefghi", 5)]
    ids = {x: i for i, x in enumerate(sorted({x for a, b, _ in pairs for x in (a, b)}))}
    rows = spark.createDataFrame([(i, x) for x, i in ids.items()], "id long, line string")
    bands = {r.id: set(r.bands) for r in lines.signatures(rows).collect()}
    by_length = defaultdict(list)
    for a, b, n in pairs:
        by_length["few" if n <= lines.FEW else "many"].append(bool(bands[ids[a]] & bands[ids[b]]))
    assert len(by_length["few"]) > 400 and all(by_length["few"])
    assert len(by_length["many"]) > 400 and sum(by_length["many"]) >= 0.99 * len(by_length["many"])


def test_short_lines_are_joined(make_docs):
    rows = [(1, "abcdefgh\nabcdefghi"), (2, "aaaaa\naaaaaaaa\nzzzzz"), (3, "abcdefgh"), (4, "abcd\nabce\nabcde\nabcdef")]
    expected, named, kept = compare(rows, result(lines.line_classes(make_docs(rows))))
    assert named == expected and kept == len(expected)
    assert frozenset({"abcdefgh", "abcdefghi"}) in named and frozenset({"aaaaa", "aaaaaaaa"}) in named
