import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import linededup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def brute(texts, min_words=5):
    """Removed places of each (doc_id, text), all earlier lines compared one by one."""
    earlier, gone = [], {}
    for doc, text in texts:
        for place, line in enumerate((text or "").split("\n")):
            words = line.split()
            if not words:
                continue
            if any(words == w or min(len(words), len(w)) >= min_words and abs(len(w) - len(words)) < 2 and edit_distance(words, w) <= 1 for w in earlier):
                gone.setdefault(doc, set()).add(place)
            earlier.append(words)
    return gone


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_one_edit_and_shared_keys(a, b):
    near = edit_distance(a, b) <= 1
    assert linededup.within_one_edit(a, b) == near
    x, y = (linededup.deletion_keys([w.encode() for w in v]) for v in (a, b))
    if near and a != b:
        same_place = any(p == q for p, q in zip(x[1:], y[1:])) if len(a) == len(b) else False  # noqa: B905
        assert same_place or (len(a) != len(b) and ((x[0] in y[1:]) or (y[0] in x[1:])))
    if near:
        for k in set(linededup._shared_sides(len(a))) & set(linededup._shared_sides(len(b))):
            longer = max(len(a), len(b))
            if k == ((longer - 1) // 2) // linededup._GRID * linededup._GRID:
                assert a[:k] == b[:k] or a[len(a) - k :] == b[len(b) - k :]


def make_texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))] for _ in range(30)]
    texts = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            line = list(rng.choice(pool)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    line.insert(at, rng.choice(vocabulary))
                elif line and kind == 1:
                    line[at % len(line)] = rng.choice(vocabulary)
                elif line:
                    del line[at % len(line)]
            lines.append((" " if rng.random() < 0.9 else " \t").join(line))
        texts.append((doc, "\n".join(lines)))
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = make_texts(seed)
        shuffled = texts[:]
        random.Random(9).shuffle(shuffled)
        docs = spark.createDataFrame([(t, d, "x", 5, 3) for d, t in shuffled], "text string, doc_id long, blob string, line int, n_chars long")
        got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
        gone = brute(texts)
        for doc, text in texts:
            kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ()))
            assert got[doc]["text"] == kept and got[doc]["n_chars"] == len(kept)
            assert got[doc]["lines_removed"] == len(gone.get(doc, ())) and got[doc]["blob"] == "x"


def test_odd_rows(spark):
    line = "one two three four five six"
    rows = [(1, line), (1, line), (2, line), (3, None), (4, ""), (5, " \n\n"), (None, "one two three four five seven"), (None, "quite another line of words"), (6, "word " * 50_000), (7, "a"), (8, "b"), (9, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0] is None, r[0], r[1]) for r in linededup.dedup_lines(docs).collect()), key=repr)
    want = [(False, 1, line)] * 2 + [(False, 2, ""), (False, 3, None), (False, 4, ""), (False, 5, " \n\n"), (True, None, ""), (True, None, "quite another line of words"), (False, 6, "word " * 50_000), (False, 7, "a"), (False, 8, "b"), (False, 9, "")]
    assert got == sorted(want, key=repr)
    left = linededup.dedup_lines(docs, drop_emptied=True)
    assert sorted(r[0] or 0 for r in left.collect()) == [0, 1, 1, 3, 4, 5, 6, 7, 8]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_dropping_emptied_rows_cuts_once(spark):
    """A filter on what the cut returns must not bring a second cut, with workers of its own, into the same tasks."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c d\na b")], "doc_id long, text string")
    cut = linededup.dedup_lines(docs, drop_emptied=True).select("doc_id", "text")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [_without(") == 1
    assert sorted(map(tuple, cut.collect())) == [(1, "a b"), (3, None), (4, "c d")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=5, max_size=40), st.integers(0, 2), st.integers(0, 40), st.sampled_from("abc"))
def test_members_past_the_shared_side_suffice(a, kind, at, word):
    """A line that shares only its first words emits no member that lacks one of those; two lines within one edit still meet."""
    at %= len(a)
    b = a[:at] + [[word], [], [word, a[at]]][kind] + a[at + 1 :]
    if a == b:
        return
    longer = max(len(a), len(b))
    k = ((longer - 1) // 2) // linededup._GRID * linededup._GRID
    for front, back in ((k, None), (None, k)):
        if k and (a[:k] != b[:k] if front else a[len(a) - k :] != b[len(b) - k :]):
            continue
        lines = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(a), " ".join(b)]), pa.array([front] * 2, pa.int32()), pa.array([back] * 2, pa.int32())], names=["id", "text", "front", "back"])
        keys = [r for batch in linededup._neighbourhoods(iter([lines])) for r in batch.to_pylist()]
        assert len(keys) == 2 + len(a) + len(b) - 2 * k
        x, y = ({(r["v1"], r["v2"], r["at"]) for r in keys if r["id"] == i} for i in (1, 2))
        if len(a) == len(b):
            assert {v for v in x if v[2] >= 0} & y
        else:
            x, y = (x, y) if len(a) > len(b) else (y, x)
            assert {v[:2] for v in x if v[2] >= 0} & {v[:2] for v in y if v[2] < 0}


def test_lines_of_uneven_texts():
    """Lines are told by their words, however these are spaced."""
    line = "one two\x1fand three é x five six seven eight nine ten"
    texts = [line, f" {line} ", line.replace(" ", "\t \r"), None, "", "\n\n \n", f"\x0b\n{line}\x0c\n\n  a \x00b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(range(7)), pa.array(texts)], names=["doc", "row", "text"])
    found = [r for b in linededup._lines(5)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc"], r["line"], r["words"]) for r in found] == [(0, 0, 10), (1, 0, 10), (2, 0, 10), (6, 1, 10), (6, 3, 2)]
    assert len({tuple(r[c] for c in ("h1", "h2", "front", "back", "front2", "back2")) for r in found}) == 2
    assert found[0]["front"] is not None and found[0]["front2"] is None and found[-1]["front"] is None


def test_near_lines_with_other_spaces(spark):
    """White space other than ASCII parts words for the edit distance; a line told apart by it hides no other near line."""
    rest = "w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"
    texts = [(1, f"a\xa0b w2 {rest}"), (2, f"x w2 {rest}"), (3, f"y w2 {rest}"), (4, f"y\xa0 w2 {rest}"), (5, f"u v {rest}")]
    got = {r["doc_id"]: r["lines_removed"] for r in linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    gone = brute(texts)
    assert gone == {3: {0}, 4: {0}}
    assert got == {doc: len(gone.get(doc, ())) for doc, _ in texts}
