"""The operators for language-model data on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from conftest import frame_rows
from pyspark.sql import functions as F

from tonelake.llm import lines, mixing, neardup, reading, split, tokens, turns

# --- 6 tokens


@pytest.fixture(scope="module")
def transducer():
    _, data, lookahead = tokens.vocabulary(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    return tokens.Transducer(tokens.read_ranks(data), lookahead)


def texts_of_all_kinds():
    rng = random.Random(3)
    pool = ["Sales rose 5%.", "  naïve café\t\n", "日本語のテキスト", "😀👩‍👩‍👧", "<|endoftext|>", "can't we'll I'd", "x" * 30, "  \x1c\x85", "é", "१२३", " ", "\r\n\r\n", "ﬁ", "Ꙁ", "0.000,1"]
    return ["", *pool, *["".join(rng.choice(pool) for _ in range(12)) for _ in range(60)], "a" * 20_000, "ab1 " * 4000, "\n" * 3000]


def test_tokens_match_public_libraries(transducer):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=transducer.ranks, special_tokens={})
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for t in texts_of_all_kinds():
        ids = transducer.encode(t)
        assert ids == own.encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids
        assert ids == list(transducer.stream(t))


def test_window_changes_nothing(transducer):
    rng = random.Random(5)
    for kind in ("ab", "etaoin", "01", "aA_-"):
        word = "".join(rng.choice(kind) for _ in range(transducer.window * 3)).encode()
        assert list(transducer.word(word)) == [transducer.ranks[p] for p in tokens._merge(word, transducer.ranks)]


def test_decoding_is_a_round_trip(transducer):
    names = {v: k for k, v in transducer.ranks.items()}
    for t in texts_of_all_kinds():
        assert tokens.decode(transducer.encode(t), names) == t
    assert tokens.decode([transducer.ranks[b"\xe2"]], names) == "�"


def test_encode_column(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Hi there", 9), (3, "Hi there", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.encode_column(df, "doc_id", "text").collect())
    assert got[(1, ())] == got[(2, ())] == 1 and got[(3, (17250, 612))] == 2 and len(got) == 4
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert all(r["same"] for r in tokens.round_trip(df, "doc_id", "text").collect())


# --- 2 splitting


def test_pieces(spark):
    prose = "\n\n".join(" ".join(f"Sentence {i} of paragraph {j} ends here." for i in range(30)) for j in range(12))
    items = {"prose": prose, "hard": "Start. " + "y" * 9000 + " end.", "run": "a b " * 500 + "z" * 3900 + " c d " * 300, "emoji": "😀🎉 x" * 2000, "short": "short", "crlf": ("line of words\r\n" * 60 + "\r\n") * 8, "spaces": " " * 9000, "limit": "w" * 4000}
    df = spark.createDataFrame([(k, v, "clash", 1) for k, v in items.items()] + [("prose", prose, "clash", 1), ("none", None, "c", 1), ("empty", "", "c", 1), (None, prose, "c", 1)], "k string, t string, piece string, start int")
    rows = split.pieces(df, "s", "k", "t").orderBy("item_key", "piece_no").collect()
    by = {k: [r for r in rows if r["item_key"] == k] for k in items}
    for k, text in items.items():
        assert "".join(r["piece"][r["shared"] :] for r in by[k]) == text
        assert all(len(r["piece"]) <= 4000 and text[r["start"] : r["start"] + len(r["piece"])] == r["piece"] for r in by[k])
        assert [r["piece_no"] for r in by[k]] == list(range(len(by[k])))
    assert len(by["limit"]) == len(by["short"]) == 1 and {r["item_key"] for r in rows} == set(items)
    assert all(r["piece"].endswith("\n\n") for r in by["prose"][:-1]) and all(150 <= r["shared"] <= 250 for r in by["prose"][1:])
    assert any("z" * 3900 in r["piece"] for r in by["run"])
    kinds = dict((r["item_key"], r["boundary"]) for r in split.cut_kinds(df, "s", "k", "t").collect())
    assert kinds == {"prose": "natural", "hard": "hard", "run": "natural", "emoji": "natural", "crlf": "natural", "spaces": "natural"}
    assert split.pieces(df.limit(0), "s", "k", "t").count() == split.cut_kinds(df.limit(0), "s", "k", "t").count() == 0


def test_boundary_is_what_cut(spark):
    """The alternative that cut says the same as a plain search for a long run, on random texts around every limit."""
    rng, limit = random.Random(5), 40
    words = lambda: rng.choice(["a", "bc.", "x" * rng.randrange(25, 50), "y!\u00a0z", ".)", "q" * 32, "q" * 40, "q" * 41])
    texts = ["".join(w + rng.choice(["", " ", " ", "\n", "\r\n", "\t", "\n \n", "\u00a0", "  "]) for w in (words() for _ in range(rng.randrange(1, 12)))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {int(r["item_key"]): r["boundary"] for r in split.cut_kinds(df, "s", "k", "t", limit, 6, 2).collect()}
    assert got == {i: "hard" if max(map(len, re.split(r"[ \t\r\n]", t))) > limit else "natural" for i, t in enumerate(texts) if len(t) > limit}
    assert len(set(got.values())) == 2
    pieces: dict = {}
    for r in split.pieces(df, "s", "k", "t", limit, 6, 2).orderBy("item_key", "piece_no").collect():
        assert len(r["piece"]) <= limit
        pieces[int(r["item_key"])] = pieces.get(int(r["item_key"]), "") + r["piece"][r["shared"] :]
    assert pieces == {i: t for i, t in enumerate(texts) if t}


def test_overlap_reaches_over_short_bodies(spark):
    """Bodies that end at ever weaker boundaries may be short; the overlap goes back over all of them, to the start of the text if it must."""
    short = "A b c d.\n\nItem 1. Heading of it\nword word "
    items = {"inside": "Words of a sentence here. " * 40 + short + "y" * 9000, "start": short + "y" * 9000}
    df = spark.createDataFrame(list(items.items()), "k string, t string")
    rows = split.pieces(df, "s", "k", "t").orderBy("item_key", "piece_no").collect()
    for k, text in items.items():
        mine = [r for r in rows if r["item_key"] == k]
        assert "".join(r["piece"][r["shared"] :] for r in mine) == text
        assert all(text[r["start"] : r["start"] + len(r["piece"])] == r["piece"] for r in mine)
        assert min(len(r["piece"]) - r["shared"] for r in mine) < 10
        assert all(r["start"] == 0 or 150 <= r["shared"] <= 250 for r in mine)
        assert all(b["shared"] <= len(a["piece"]) for a, b in zip(mine, mine[1:]))


# --- 3 near-duplicates


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for m in range(4):
            own = list(words)
            for _ in range(rng.choice((0, 2, 6, 12, 30))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice(([], [rng.choice(vocabulary)], own[at : at + 1] * 2))
            rows.append((f"{g:03d}-{m}", " ".join(own).capitalize() + ".", "c"))
    rows += [("copy-1", rows[0][1], "c"), ("copy-1", rows[0][1], "c"), ("null", None, "c"), ("empty", "", "c"), ("two", "Two words", "c"), ("two-b", "Two words", "c"), (None, rows[0][1], "c"), ("case", rows[0][1].upper(), "c")]
    df = spark.createDataFrame(rows, "k string, t string, a string")
    sets = {}
    for k, t, _ in rows:
        w = neardup._WORD.findall((t or "").lower())
        if k and len(w) > 2:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    names = sorted(sets)
    truth = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= 0.55 * len(sets[a] | sets[b])}
    found = [(r["x"], r["y"]) for r in neardup.similar_pairs(df, "k", "t", ("x", "y")).collect()]
    assert len(found) == len(set(found)) and set(found) == truth
    groups = {r["k"]: r for r in neardup.similar_groups(df, "k", "t").collect()}
    assert groups["copy-1"]["class_id"] == groups["000-0"]["class_id"] and groups["null"]["group_id"] is None and groups["two"]["class_id"] == groups["two-b"]["class_id"]
    assert all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in truth)
    assert neardup.similar_pairs(df.limit(0), "k", "t").count() == 0 and neardup.similar_groups(df.limit(0), "k", "t").count() == 0


def test_hot_bucket_is_split(spark):
    rows = spark.range(300).selectExpr("1L as g", "300L as n", "id as c")
    assert neardup._meetings(rows, "g", "n", "c", 64).distinct().count() == 300 * 299 // 2


def test_frequent_keys_give_the_same_pairs(spark, monkeypatch):
    """A third of all texts are nearly one text: keys that the sample calls frequent take the way over blocks."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(f"h{i:03d}", " ".join(base[: i % 7] + [f"x{i}"] + base[i % 7 :])) for i in range(100)] + [(f"u{i:03d}", " ".join(f"v{rng.randrange(5000)}" for _ in range(120))) for i in range(200)]
    df = spark.createDataFrame([*rows, *rows[:3]], "k string, t string").repartition(5)
    plain = sorted(map(tuple, neardup.similar_pairs(df, "k", "t").collect()))
    monkeypatch.setattr(neardup, "SAMPLED", 2)
    monkeypatch.setattr(neardup, "FREQUENT", 3)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    assert sorted(map(tuple, neardup.similar_pairs(df, "k", "t").collect())) == plain and len(plain) == 100 * 99 // 2


def test_pairs_in_order():
    rng = random.Random(8)
    rows = sorted((rng.randrange(40), rng.randrange(200)) for _ in range(900)) + [(99, i) for i in range(150)]
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows[i : i + 37]]), pa.array([c for _, c in rows[i : i + 37]])], names=["g", "c"]) for i in range(0, len(rows), 37)]
    got = {(a, b) for out in neardup._met_in_order(iter(batches)) for a, b in zip(*(x.to_pylist() for x in out.columns))}
    assert got == {(a, b) for g, a in rows for h, b in rows if g == h and a < b}
    assert list(neardup._met_in_order(iter([]))) == []


def test_components(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    roots = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert roots["060"] == "000" and roots["y"] == "x" and len(roots) == 63


# --- 5 repeated lines


def test_repeated_lines(spark):
    notice = "This notice is printed on every single page 1"
    rows = []
    for i in range(12):
        body = [f"Unique content of document number {'abcdefghijkl'[i] * 30}"]
        if i < 5:
            body += [f"  {notice.upper().replace('1', str(i))} ***", notice]  # a variant and the line itself: one document
        if i < 3:
            body.append("Too few documents hold this long line of text")
        body += ["Item 7. Management discussion of everything there is", "short line"]
        rows.append((f"d{i:02d}", " abc" if i % 2 else "ABC ", "\n".join(body), "clash"))
    rows += [rows[0], ("null", None, notice, "c"), ("blank", " ", notice, "c"), ("empty", "ABC", "", "c"), ("none", "ABC", None, "c"), (None, "ABC", notice, "c")]
    rows += [(f"z{i}", "ZZZ", f"{notice}\r\nx", "c") for i in range(3)]
    df = spark.createDataFrame(rows, "k string, s string, t string, line string")
    found = frame_rows(lines.repeated_lines(df, "k", "s", "t"))
    assert found == sorted((f"d{i:02d}", n) for i in range(5) for n in (2, 3))
    clean = {r["k"]: r for r in lines.without_repeated_lines(df, "k", "s", "t").collect()}
    assert clean["d00"]["removed"] == 2 and "notice" not in clean["d00"]["t"].lower() and clean["d05"]["removed"] == 0
    assert clean["none"]["t"] is None and clean["null"]["t"] == notice and len(clean) == 12 + 4 + 3
    assert lines.repeated_lines(df.limit(0), "k", "s", "t").count() == 0


def test_share_of_documents_counts(spark):
    line = "A line that only a few of very many documents hold"
    df = spark.createDataFrame([(i, "T", line if i < 5 else f"plain {i}") for i in range(30)], "k int, s string, t string")
    assert lines.repeated_lines(df, "k", "s", "t").count() == 0
    assert lines.repeated_lines(df.where("k < 25"), "k", "s", "t").count() == 5


# --- 7 mixing


def test_flow_prefers_fresh_tokens_and_serves_overlaps():
    given = mixing.plan({("a",): 100, ("a", "b"): 100, ("b",): 0}, 200, [("a", 1.0, 2), ("b", 1.0, 2)], 1.0)
    assert given == {(("a",), "a"): 100, (("a", "b"), "b"): 100}
    given = mixing.plan({("a",): 10}, 100, [("a", 1.0, 3), ("b", 1.0, 9)], 1.0)
    assert given == {(("a",), "a"): 30}


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "ab"[i % 4 == 0], rng.randrange(1, 60), 7) for i in range(4000)] + [(9001, None, 50, 7), (9002, "a", None, 7), (9003, "a", 0, 7), (None, "a", 10, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, repeats int")
    mixes = spark.createDataFrame([(1, "a", 1.0, 2, 0.5), (1, "b", 3.0, 4, 0.5), (2, "a", 1.0, 1, 3.0), (2, "b", None, 1, 3.0), (3, "c", 1.0, 5, 1.0), (3, "b", 1.0, None, 1.0), (None, "a", 1.0, 1, 1.0), (4, None, 1.0, 1, 1.0)], "mix_id int, source string, weight double, max_repeats int, total_ratio double")
    chosen, shares = mixing.mixture(docs, mixes)
    s = {(r["mix_id"], r["source"]): r for r in shares.collect()}
    assert abs(s[1, "a"]["actual_share"] - 0.25) < 0.002 and abs(s[1, "b"]["actual_tokens"] - s[1, "b"]["target_tokens"]) < 60
    total_a = sum(r[2] or 0 for r in rows if r[1] == "a" and r[0] is not None)
    assert s[2, "a"]["actual_tokens"] == total_a and s[2, "b"]["target_share"] == 0 and s[3, "c"]["documents"] == 0 and s[3, "c"]["target_share"] == 0.5
    got = chosen.collect()
    assert len({(r["mix_id"], r["source"], r["doc_id"]) for r in got}) == len(got)
    assert max(r["repeats"] for r in got if r["mix_id"] == 1 and r["source"] == "b") <= 4 and all(r["repeats"] > 0 for r in got)
    assert frame_rows(mixing.mixture(docs, mixes)[0]) == sorted((tuple(r) for r in got), key=repr)
    empty, none = mixing.mixture(docs.limit(0), mixes)
    assert empty.count() == 0 and none.count() == 6
    assert mixing.mixture(docs, mixes.limit(0))[0].count() == 0


def test_shared_documents_are_used_evenly(spark):
    """Sources that own the same documents split them: nothing is repeated while a document is unused."""
    docs = spark.createDataFrame([(i, ["a", "b"], 100) for i in range(400)], "doc_id long, source array<string>, n_tokens long")
    mixes = spark.createDataFrame([(m, s, 1.0, 3, ratio) for m, ratio in ((1, 1.0), (2, 1.5), (3, 0.25)) for s in "ab"], "mix_id int, source string, weight double, max_repeats int, total_ratio double")
    used = {}
    for r in mixing.mixture(docs, mixes)[0].collect():
        used.setdefault(r["mix_id"], {}).setdefault(r["doc_id"], []).append(r["repeats"])
    assert sorted(sum(v) for v in used[1].values()) == [1] * 400
    assert sorted(sum(v) for v in used[2].values()) == [1] * 200 + [2] * 200
    assert sorted(sum(v) for v in used[3].values()) == [1] * 100
    many = mixing.mixture(docs.withColumn("n_tokens", F.lit(1)), mixes)[0]  # arcs end inside steps
    assert many.where("mix_id = 1").groupBy("doc_id").agg(F.sum("repeats").alias("n")).where("n <> 1").isEmpty() and many.where("mix_id = 1").select("doc_id").distinct().count() == 400


def test_laps_and_arcs():
    assert mixing.laps_by_price(3) == [(1, 1), (2, 1), (3, 1)] and mixing.laps_by_price(0) == []
    assert sum(n for _, n in mixing.laps_by_price(10**9)) == 10**9 and len(mixing.laps_by_price(10**9)) < 100
    assert mixing.arcs(10, [("a", 7), ("b", 15), ("c", 10)], 3) == [("a", 0, 3, 0), ("b", 1, 0, 5), ("c", 1, 5, 5)]


def test_mixture_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["b"], 10) for i in range(200)], "doc_id long, source array<string>, n_tokens long")
    mixes = spark.createDataFrame([(1, "a", 1.0, 1, 1.0), (1, "b", 1.0, 1, 1.0)], "mix_id int, source string, weight double, max_repeats int, total_ratio double")
    s = {r["source"]: r["actual_tokens"] for r in mixing.mixture(docs, mixes)[1].collect()}
    assert s == {"a": 1000, "b": 1000}


# --- 8 reading level


def test_sentences():
    text = "A heading\n\nThe firm sold bikes\nin the U.S. and grew. It was hard work, approx. 4 of them.\nRevenue\t1,2\t3\n- We fixed late steel in May\n- No one was hurt\n\nAll rights reserved."
    assert [" ".join(s) for s in reading.sentences(text)] == ["the firm sold bikes in the u s and grew", "it was hard work approx of them", "we fixed late steel in may", "no one was hurt"]
    assert reading.sentences("") == [] and not reading.is_case(None) and not reading.is_case("word " * 39) and reading.is_case("word " * 40)


def test_reading_levels(spark):
    rng = random.Random(4)
    words = {level: [f"{'abcd'[level - 1]}{c}{d}x" for c in "aeiou" for d in "bcdfg"] for level in (1, 2, 3, 4)}
    rows, grades, truth = [], [], {}
    for i in range(240):
        level = i % 4 + 1
        said = [level] * 7 + [min(4, level + 1), max(1, level - 1)]
        text = " ".join(" ".join(rng.choice(words[x]) for _ in range(4 + 4 * x)).capitalize() + "." for x in said)
        rows.append((i, text, "en", "clash"))
        truth[i] = level
        if i < 60:
            grades += [(i, "r1", level), (i, "r2", level if i % 3 else min(4, level + 1)), (i, "r3", level)]
    rows += [(1000, None, "en", "c"), (1001, "", "en", "c"), (1002, "too short", "en", "c"), (1003, rows[0][1], "de", "c"), (1004, rows[0][1], None, "c"), (None, rows[0][1], "en", "c"), (1005, "1 2 3 " * 40, "en", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, reading_level string")
    g = spark.createDataFrame([*grades, (1, None, 9), (None, "r", 1)], "doc_id long, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, g).collect()}
    assert got.pop(1005) is None and set(got) == set(truth)
    assert sum(got[i] == truth[i] for i in truth if i >= 60) / 180 > 0.95
    assert reading.reading_levels(docs.limit(0), g).count() == 0
    assert {r["reading_level"] for r in reading.reading_levels(docs, g.limit(0)).collect()} == {None}


# --- 1 speaker turns

CALL = """Acme Goods (ACME) Q1 2024 Earnings Call
This transcript was produced by a speech service and its accuracy is not guaranteed.
Operator: Good day and welcome. Questions will be taken later in the call.
Jane Doerwick - IR: Thank you. With me today are John Marlowen, Chief Executive Officer, and Mary Feldstar, Treasurer. I am Jane Doerwick, Head of IR.
John Marlowen - CEO: We um, sold more [laughter] this quarter than ever.
Margins: they were fine and grew again this year.
J. Marlowen: Hmm. uh, Right,
CEO: And we will (inaudible) sell even more next year.
Mrs. Feldstra: Cash was strong in every single month.
The Operator: We will now begin the question-and-answer session. First is Ann Quillstone with Bay Research.
Quillstone, Ann: Thanks. Could you talk about costs?
Unknown Speaker: Sorry, could you repeat the number?
JOHN  MARLOWEN (continued): Costs were flat, as we said before.
Duration: 5 minutes"""


def call_turns(text, roster=None):
    parts, unspoken = turns.stretches(text)
    return turns.Call(parts, turns.stated(parts, unspoken), roster or {}).turns()


def test_turns():
    got = [t[:4] for t in call_turns(CALL)]
    assert got == [
        ("prepared_remarks", 0, "Operator", "Operator"), ("prepared_remarks", 1, "Jane Doerwick", "IR"), ("prepared_remarks", 2, "John Marlowen", "CEO"), ("prepared_remarks", 3, "Mary Feldstar", "unknown"),
        ("qa", 0, "Operator", "Operator"), ("qa", 1, "Ann Quillstone", "Analyst"), ("qa", 2, "Unknown", "unknown"), ("qa", 3, "John Marlowen", "CEO"),
    ]
    said = call_turns(CALL)[2][4]
    assert said == "We sold more this quarter than ever. Margins: they were fine and grew again this year. And we will sell even more next year."


def test_layouts_give_the_same_turns():
    want = [t[:4] for t in call_turns(CALL)]
    labelled = [x.split(": ", 1) for x in CALL.split("\n")[2:-1]]
    timed = [f"[00:0{i // 6}:{i % 6}0] {a}: {b}" for i, (a, b) in enumerate(x for x in labelled if x[0] != "Margins")]
    random.Random(1).shuffle(timed)
    assert [t[:4] for t in call_turns("\n\n".join(timed))] == want
    assert [t[:4] for t in call_turns("Acme Goods (ACME) Q1 2024 Earnings Call " + " ".join(timed))] == want
    html = "".join(f"<p><strong>{a}:</strong>&nbsp;{b}</p>" for a, b in labelled if a != "Margins")
    assert [t[:4] for t in call_turns(html)] == want
    cues = "WEBVTT\r\n\r\n" + "\r\n\r\n".join(f"00:0{i // 6}:{i % 6}0.000 --> 00:0{i // 6}:{i % 6}9.000\r\n{a}: {b}" for i, (a, b) in enumerate(x for x in labelled if x[0] != "Margins"))
    assert [t[:4] for t in call_turns(cues)] == want
    assert [t[:4] for t in call_turns(CALL.replace("\n", "\r\n"))] == want


def test_call_without_questions():
    text = "\n".join(x for x in CALL.split("\n") if "Quillstone" not in x and "Unknown" not in x)
    assert {t[0] for t in call_turns(text)} == {"prepared_remarks"}


def test_title_alone_names_its_holder():
    text = CALL.replace("Mrs. Feldstra:", "TREASURER:").replace("CEO: And", "Chief Executive Officer: And")
    assert [t[:4] for t in call_turns(text)] == [t[:4] for t in call_turns(CALL)]
    assert call_turns(CALL.replace("Mrs. Feldstra:", "General Counsel:"))[3][2:4] == ("Unknown", "unknown")


def test_roster_fixes_spelling():
    text = "Operator: Welcome to the call of today.\nIlsa Quaremarkk: We are glad to be here today.\nIlsa Quaremark: And we are glad to go on now."
    got = call_turns(text, {"Ilsa Quaremark": ("COO", 3)})
    assert {t[2] for t in got} == {"Operator", "Ilsa Quaremark"} and got[1][3] == "COO"
    # labels alone can't tell: the company's other calls do
    assert call_turns(text.replace("Ilsa Quaremark:", "Ilsa Quaremarkk:"), {"Ilsa Quaremark": ("COO", 3)})[1][2:4] == ("Ilsa Quaremark", "COO")
    assert call_turns(text.replace("Ilsa Quaremark:", "Ilsa Quaremarkk:"))[1][2:4] == ("Ilsa Quaremarkk", "unknown")


def test_stated_name_that_hardly_any_call_states_is_a_slip():
    text = "Operator: Good day. Our next question is from Bryda Kelandri with Tindall Partners.\nBryda Kelandry: Could you talk about the costs of this year?\nBryda Kelandri: And one more on the sales of this year?"
    assert {t[2] for t in call_turns(text, {"Bryda Kelandry": ("Analyst", 40)})} == {"Operator", "Bryda Kelandry"}
    assert "Bryda Kelandri" in {t[2] for t in call_turns(text, {"Bryda Kelandry": ("CFO", 40)})}  # another role: another person
    assert "Bryda Kelandri" in {t[2] for t in call_turns(text, {"Bryda Kelandry": ("Analyst", 40), "Bryda Kelandri": ("Analyst", 2)})}


def test_labels_are_assigned_together():
    """Both people are one edit away from a label: the one who has no other spelling gets it."""
    text = """Host: With me are John Smithe, CEO, and Joan Smithe, CFO.
Joan Smithe: Our cash was strong in every month.
Jon Smithe: We sold more than ever in the year.
Joan Smithe: And we paid down all of our debt."""
    got = call_turns("Ann Host: Good day to all of you. " + text.split(": ", 1)[1])
    assert [t[2:4] for t in got[1:]] == [("Joan Smithe", "CFO"), ("John Smithe", "CEO"), ("Joan Smithe", "CFO")]


def test_opening():
    assert turns.opens("Operator", "Thank you. We will now begin the question-and-answer session.") and turns.opens("Ann Lee", "The floor is open for your questions.")
    assert turns.opens("Operator", "Our first caller is Bo Ray.") and turns.opens("Operator", "To queue, press star one on your phone now.")
    assert not turns.opens("Operator", "Questions will be taken later in the call.") and not turns.opens("Operator", "After the remarks there will be a question-and-answer session.")
    assert not turns.opens("Bo Ray", "Operator, please open the line for questions.") and not turns.opens("Bo Ray", "Sales rose this quarter.")


def test_blocks(spark):
    df = spark.createDataFrame([("Ilsa Quaremark",), ("Ilsa Quarremarkk",), ("Bo Li",)], "n string")
    got = [set(r[0]) for r in df.select(turns.sounds(F.col("n"))).collect()]
    assert got[0] & got[1] >= {"f26562", "gilsaq"} and not got[0] & got[2]


def test_assignment_is_one_to_one():
    price = {("x", "p"): 1, ("x", "q"): 2, ("y", "p"): 1}
    assert turns.assign(["x", "y"], ["p", "q"], lambda f, p: price.get((f, p))) == {"x": "q", "y": "p"}
    price = {("x", "p"): 1, ("x", "q"): 9, ("y", "p"): 1}  # too dear: one person with two spellings costs less
    assert turns.assign(["x", "y"], ["p", "q"], lambda f, p: price.get((f, p))) == {"x": "p", "y": "p"}


def test_speaker_turns(spark):
    rows = [(1, " acme", CALL, "c"), (1, " acme", CALL, "c"), (2, None, CALL, "c"), (3, "ACME", None, "c"), (4, "ACME", "", "c"), (None, "ACME", CALL, "c"), (5, "ACME", "no label at all", "c"), (6, "ACME", CALL + "\n" + "x y z " * 50_000, "c")]
    df = spark.createDataFrame(rows, "transcript_id long, ticker string, raw_text string, section string")
    got = turns.speaker_turns(df)
    assert {r["transcript_id"]: r["n"] for r in got.groupBy("transcript_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {1: 8, 2: 8, 6: 8}
    assert turns.speaker_turns(df.limit(0)).count() == 0
