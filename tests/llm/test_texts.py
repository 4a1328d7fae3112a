"""Problems 5 to 8."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import leakage, mixture, quality, tokens
from quillspan.llm.rule_induction import case_sql, induce, predict

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def test_leakage_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(i, "s", "en", " ".join(rng.choice(WORDS, 30)) + f" q{i}?", f"answer{i}") for i in range(6)]
    items += [(7, "s", None, "too short", None), (8, "s", "en", None, None), (9, "s", "en", items[0][3], "other")]
    docs = []
    for i in range(80):
        own = items[int(rng.integers(6))][3].split()
        a, n = int(rng.integers(0, 25)), int(rng.integers(8, 20))
        part = own[a : a + n]
        if i % 3 == 0:
            part = [f"**{w.upper()}**" for w in part]
        docs.append((i, "intro words here. " + " ".join(part) + ("\n> " if i % 2 else ", ") + " ".join(rng.choice(WORDS, 10)), 0))
    docs += [(90, None, 0), (91, "", 0), (92, "x " * 50_000 + items[2][3], 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, start int")
    it = spark.createDataFrame(items, "item_id long, suite string, lang string, text string, answer string")
    want = set()
    for doc, text, _ in docs:
        w = leakage.normalised(text or "").split()
        seen = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, _, _, t, _ in items:
            own = leakage.normalised(t or "").split()
            if any(tuple(own[k : k + 12]) in seen for k in range(len(own) - 11)):
                want.add((doc, i))
    for block in (leakage.MAX_BLOCK_CHARS, 200):
        got = leakage.leaked_passages(d, it, max_block_chars=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    by_doc = {x[0]: x[1] for x in docs}
    for r in got:
        assert len(leakage.normalised(by_doc[r.doc_id][r.start : r.stop]).split()) == r.n_words
    assert leakage.leaked_passages(d, it.limit(0)).count() == 0 and leakage.leaked_passages(d.limit(0), it).count() == 0


def test_leakage_forms():
    own = "The keeper of Xeiqui painted 12 valves green, and by winter owed the mill 943 coins."
    forms = ["the KEEPER of Xei​qui <b>painted</b> [12](/x) valves green and by winter owed the mill 943 coins", own.replace("e", "е"), "- " + own.replace(" ", "\n- ")]
    base = leakage.normalised(own).split()
    assert all(leakage.normalised(f).split() == base for f in forms)


def test_leakage_look_alikes_of_capitals():
    own = "BETTER Keys MAKE New Tables; HAZE KNOWS The Mill"
    latin, cyr, gre = "BKMHT", "\u0412\u041a\u041c\u041d\u0422", "\u0391\u0392\u0395\u0396\u0397\u039a\u039c\u039d\u03a1\u03a4\u03a7"
    for alike in (str.maketrans(latin, cyr), str.maketrans("ABEZHKMNPTX", gre)):
        assert leakage.normalised(own.translate(alike)) == leakage.normalised(own)
    for text in ("\u0412\u0442\u043e\u0440\u0430\u044f \u043a\u043d\u0438\u0433\u0430", "\u039d\u03ad\u03bf \u03b2\u03b9\u03b2\u03bb\u03af\u03bf"):
        assert leakage.normalised(text) == leakage.normalised(text.lower())
    assert leakage.normalised("\u0412\u0422\u041e\u0420\u0410\u042f \u041a\u041d\u0418\u0413\u0410") == leakage.normalised("\u0432\u0442\u043e\u0440\u0430\u044f \u043a\u043d\u0438\u0433\u0430")


def test_leakage_offsets(spark):
    """Offsets are of the stored text past tags, link targets and line numbers, and the longer of two readings holds."""
    own = "the keeper of the mill painted twelve valves green and by winter owed it coins"
    w = own.split()
    docs = [
        (0, f"intro <div class='a b'>x</div> {' '.join(w[:6])} <b>{w[6]}</b> [{' '.join(w[7:9])}](/t 'u') {' '.join(w[9:])} end"),
        (1, "1. " + f"\n2. ".join([" ".join(w[:5]), " ".join(w[5:9]), " ".join(w[9:])])), (2, f"{own} 7"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(1, own, "coins")], "item_id long, text string, answer string")
    got = {r.doc_id: r for r in leakage.leaked_passages(d, it).collect()}
    assert all(r.n_words == len(w) for r in got.values()) and len(got) == 3
    for k, text in docs:
        part = text[got[k].start : got[k].stop]
        assert part.startswith("the keeper") and part.endswith("coins") and got[k].has_answer


def _tables(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.x.example/1", "https://A.x.example/", "EN"), (2, "https://b.x.example/2", None, "deutsch"), (3, "https://c.test/3", "https://c.test", None)],
        "page_id long, url string, origin string, lang string",
    )
    chunks = spark.createDataFrame(
        [(1, 1, None, "one two three"), (1, 1, None, "one two three"), (2, 1, None, "one two three"), (3, 2, None, "vier"), (4, 3, None, None), (5, 9, "https://z.test", "five six")],
        "chunk_id long, page_id long, origin string, content string",
    )
    return chunks, pages


def test_token_totals_and_deltas(spark):
    chunks, pages = _tables(spark)
    encode = tokens._encoding(tokens._vocabulary(tokens.TOKENIZER)[0]).encode_ordinary
    three, vier, five = (len(encode(x)) for x in ("one two three", "vier", "five six"))
    counts = tokens.encode_unseen(tokens._contents(chunks), None)
    assert counts.count() == 3
    snapshot = tokens.page_tokens(chunks, pages, counts)
    got = {(r.slice, r.name): (r.n_pages, r.n_chunks, r.n_tokens) for r in tokens.totals(tokens.updated_cube(None, tokens.deltas(None, snapshot))).collect()}
    assert got["domain", "x.example"] == (2, 3, 2 * three + vier) and got["lang", "und"] == (2, 2, five) and got["lang", "de"] == (1, 1, vier)
    assert got["site", "https://a.x.example"] == (1, 2, 2 * three)
    # page 2 goes, page 1 changes: the signed deltas give what a fresh count gives, and only the new text is encoded
    later = chunks.where("page_id <> 2").withColumn("content", F.when(F.col("chunk_id") == 2, "new text").otherwise(F.col("content")))
    more = tokens.encode_unseen(tokens._contents(later), counts)
    assert more.count() == 1
    known = counts.union(more.select(counts.columns))
    new = tokens.page_tokens(later, pages, known)
    cube = tokens.updated_cube(tokens.updated_cube(None, tokens.deltas(None, snapshot)), tokens.deltas(snapshot, new))
    fresh = tokens.updated_cube(None, tokens.deltas(None, new))
    assert sorted(map(tuple, cube.collect())) == sorted(map(tuple, fresh.collect()))
    assert tokens.totals(tokens.updated_cube(None, tokens.deltas(None, tokens.page_tokens(chunks.limit(0), pages, counts)))).count() == 0


def test_budget_is_kept_at_a_path(spark, tmp_path):
    chunks, pages = _tables(spark)
    budget = tokens.Budget(spark, f"file://{tmp_path}/budget")
    assert budget.version() == 0 and budget.counts() is None and budget.cube() is None
    assert budget.update(chunks, pages) == 1 and budget.counts().count() == 3
    later = chunks.where("page_id <> 2").withColumn("content", F.when(F.col("chunk_id") == 2, "new text").otherwise(F.col("content")))
    spark.range(1).write.parquet(f"file://{tmp_path}/budget/v=2/cube")  # an update that broke off
    again = tokens.Budget(spark, f"file://{tmp_path}/budget")
    assert again.version() == 1 and again.update(later, pages) == 2 and again.counts().count() == 4
    fresh = tokens.Budget(spark, f"file://{tmp_path}/fresh")
    fresh.update(later, pages)
    cells = lambda b: sorted(map(tuple, b.cube().collect()))
    assert cells(again) == cells(fresh)
    assert again.update(chunks.limit(0), pages) == 3 and again.cube().count() == 0 and again.snapshot().count() == 0


def test_mixture(spark):
    rng = np.random.default_rng(1)
    docs = [(i, ["big", "mid", "tiny", "unlisted", None][i % 5 if i % 7 else 0], "word " * int(rng.integers(1, 30))) for i in range(600)]
    docs += [(1000, "tiny", None), (1001, "tiny", " ")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3), (None, 0.1, 1), ("none", None, None)], "source string, target_share double, max_repeats int")
    taken, plan = mixture.mix(d, t, "strict")
    report = {r.source: r for r in mixture.shares(taken, plan).collect()}
    for s, share in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("tiny", 0.1 / 0.9)):
        assert abs(report[s].actual_share - share) < 0.02
    assert report["absent"].tokens == 0 and report["none"].tokens == 0
    rows = [tuple(r) for r in taken.collect()]
    assert rows and len({(r[0], r[2]) for r in rows}) == len(rows)
    for total in (None, "all", 3000, 10**9):
        taken, plan = mixture.mix(d, t, total)
        rows = taken.collect()
        budget = plan.first().budget
        used = {}
        for r in rows:
            used[r.doc_id] = used.get(r.doc_id, 0) + 1
        repeats = {"big": 1, "mid": 2, "tiny": 4}
        assert all(used[r.doc_id] <= repeats[r.source] for r in rows)
        assert sum(r.n_tokens for r in rows) <= budget
        if total == 10**9:
            assert len(rows) == sum(repeats[s] for _, s, x in docs if s in repeats and x and x.strip())
    # the queue itself, by the definition
    taken, plan = mixture.mix(d, t, 3000)
    weight = {r.source: r.weight for r in plan.collect() if r.weight}
    got = sorted(taken.collect(), key=lambda r: (r.finish, r.source, r.doc_id))
    sums = {}
    for r in got:
        sums[r.source] = sums.get(r.source, 0) + r.n_tokens
        assert abs(r.finish - sums[r.source] / weight[r.source]) < 1e-6 * r.finish + 1e-6
    # its order: the places are the running sums of the queue
    at = 0
    for r in sorted(got, key=lambda r: (r.finish, r.source, r.doc_id, r.copy)):
        at += r.n_tokens
        assert r["at"] == at
    assert mixture.mix(d.limit(0), t)[0].count() == 0
    # the default budget keeps within the tolerance, a larger one doesn't
    taken, plan = mixture.mix(d, t, tolerance=0.05)
    said = mixture.shares(taken, plan).collect()
    assert sum(abs(r.actual_share - r.reachable_share) for r in said) / 2 < 0.05 + 0.02
    assert plan.first().budget < mixture.mix(d, t, "all")[1].first().budget


def test_statistics_and_rules(spark):
    common = spark.createDataFrame([("en", "the"), ("en", "of"), ("en", "is"), ("ja", "の"), (None, "x"), ("en", None)], "lang string, word string")
    texts = [None, "", " \n ", "The order of the source is kept.\nIt is so.", "a;1;2\nb;3;4\nc;5;6\nd;7;8", "###### !!! ///", "ｔｈｅ order", "x" * 300_000]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words_ int")
    got = {r.doc_id: r for r in quality.classified(d, common).collect()}
    assert [got[i].words for i in range(3)] == [0, 0, 0] and got[0].rule > 0 and got[1].common_share == 0
    assert got[3].words == 10 and got[3].punct_line_share == 1.0 and got[3].common_share == 0.5 and got[6].common_share == 0.5
    assert got[5].symbol_share == 1.0 and got[7].words == 1
    assert quality.classified(d.limit(0), common).count() == 0


def test_rule_induction(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    y = (x["a"] <= 0.3) | ((x["b"] > 0.8) & (x["a"] > 0.6))
    rules = induce({k: v[:2000] for k, v in x.items()}, y[:2000])
    assert (predict(x, rules, 3000)[2000:] == y[2000:]).mean() > 0.97
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x["a"][:50], x["b"][:50], strict=True)], "a double, b double")
    said = [r[0] > 0 for r in df.select(F.expr(case_sql(rules))).collect()]
    assert said == list(predict({k: v[:50] for k, v in x.items()}, rules, 50))


def test_held_out_accuracy(spark):
    """On documents the rules weren't learned from."""
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    common = spark.read.parquet(f"{path}/common_words.parquet")
    known = {r.word.lower() for r in common.where("lang <> 'ja'").collect()}
    rows = quality.classified(spark.read.parquet(f"{path}/documents.parquet"), common).select("text", "rule").collect()
    right = sum((quality.prose_share(r.text, known) < 0.5) == (r.rule > 0) for r in rows)
    assert right >= 0.99 * len(rows)
