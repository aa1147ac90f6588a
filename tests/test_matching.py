"""Dictionaries, pair joins, identities and sessions against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import lexicons as L
from ledgerloom.functions import text as T
from ledgerloom.operators import analysis as A
from ledgerloom.operators import dictionary as D
from ledgerloom.operators import extraction as X
from ledgerloom.operators import identity as I
from ledgerloom.operators import pairs as P
from ledgerloom.operators import rules as RU
from ledgerloom.operators import sessions as N


def sets(r, n, words, most):
    return [(i, sorted({f"w{int(r.paretovariate(0.7)) % words}" for _ in range(r.randrange(most))})) for i in range(n)]


@pytest.mark.parametrize("meet", [4096, 5])
@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_contained_sets_equal_all_pairs(spark, monkeypatch, meet, least):
    """Also with hot words dealt to parts."""
    monkeypatch.setattr(P, "MEET", meet)
    rows = sets(random.Random(int(least * 10)), 70, 40, 12)
    df = spark.createDataFrame([(i, w, i % 3) for i, w in rows], "id int, w array<string>, keep int")
    got = {(r["a_id"], r["b_id"]): (r["shared"], round(r["containment"], 9)) for r in P.contained_sets(df, F.col("w"), least, same=("keep",)).collect()}
    assert got == {(r["a_id"], r["b_id"]): (r["shared"], round(r["containment"], 9)) for r in P.contained_sets(df, F.col("w"), least, keep=("keep",), apart=F.col("a_keep") == F.col("b_keep")).collect()}
    want = {}
    for i, a in rows:
        for j, b in rows:
            shared = len(set(a) & set(b))
            if i < j and i % 3 == j % 3 and a and b and shared / min(len(a), len(b)) >= least:
                want[i, j] = (shared, round(shared / min(len(a), len(b)), 9))
    assert got == want


@pytest.mark.parametrize("meet", [4096, 5])
@pytest.mark.parametrize("least", [0.08, 0.3, 0.8])
def test_similar_sets_equal_all_pairs(spark, monkeypatch, meet, least):
    monkeypatch.setattr(P, "MEET", meet)
    rows = sets(random.Random(3), 60, 40, 12)
    got = {(r["a_id"], r["b_id"]) for r in P.similar_sets(spark.createDataFrame(rows, "id int, w array<string>"), F.col("w"), least).collect()}
    assert got == {(i, j) for i, a in rows for j, b in rows if i < j and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= least}


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_held_terms_equal_all_pairs(spark, monkeypatch, block):
    """Terms of any length, parts of one another, with marks and letters of any kind; one block and many."""
    monkeypatch.setattr(D, "BLOCK", block)
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    terms = [word(r.randrange(1, 7)) for _ in range(40)] + ["", None, "a", "aa", "aaa"]
    texts = [(i, word(r.randrange(60))) for i in range(30)] + [(30, None), (31, ""), (32, "aaaa")]
    got = Counter(tuple(x) for x in P.found_in(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(texts, "id int, n string")).collect())
    assert got == Counter((t, i) for t in set(terms) if t for i, n in texts if n and t in n)


@pytest.mark.parametrize("block", [8 << 20, 12])
def test_alias_mentions_equal_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    r = random.Random(block)
    words = ["fire", "alarm", "panel", "pump", "a", "b"]
    aliases = [(f"n{r.randrange(6)}", " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))) for _ in range(14)] + [("x", None), ("y", ""), (None, "pump"), ("z", "--")]
    texts = [(i, r.choice([" ", ", ", "-"]).join(r.choice(words).upper() for _ in range(r.randrange(25)))) for i in range(25)] + [(90, None), (91, "")]
    names = {}
    for n, a in aliases:
        if n and a and a.strip("-"):
            names.setdefault(a, set()).add(n)
    want = Counter()
    for i, text in texts:
        w = T_words(text)
        at = 0
        while at < len(w):
            best = max((len(a.split()) for a in names if w[at : at + len(a.split())] == a.split()), default=0)
            if best:
                a = " ".join(w[at : at + best])
                want[i, at, best, a, tuple(sorted(names[a]))] += 1
            at += best or 1
    got = Counter((x["id"], x["start"], x["size"], x["alias"], tuple(x["names"])) for x in D.alias_mentions(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(aliases, "name string, alias string")).collect())
    assert got == want


def T_words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def test_alias_fields(spark):
    df = spark.createDataFrame([({"Submittal No.": " 7 ", "DUE-DATE": "x", "other": "y"},), ({},), (None,)], "raw map<string,string>")
    got = [r["f"].asDict() for r in df.select(D.alias_fields(F.col("raw"), {"number": ["submittal no", "number"], "due": ["due date"]}).alias("f")).collect()]
    assert got[0] == {"number": "7", "due": "x"} and got[1] == got[2] == {"number": None, "due": None}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.75, 0.85, 1.0])
def test_similar_names_equal_all_pairs(spark, least):
    r = random.Random(int(least * 100))
    names = {"".join(r.choice("abé") for _ in range(r.randrange(1, 15))) for _ in range(60)}
    for n in list(names)[:40]:
        w = list(n)
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randrange(2)] = [r.choice("abéc")] * r.randrange(2)
        names.add("".join(w))
    names = sorted(names)
    got = {(x["a"], x["b"]): x["similarity"] for x in I.similar_names(spark.createDataFrame([(n,) for n in [*names, None, names[1]]], "name string"), least).collect()}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d, longer = distance(a, b), max(len(a), len(b))
            if a and b and d <= int(longer * (1 - least) + 1e-9):
                want[a, b] = round(1 - d / longer, 6)
    assert got == want


def test_fuzzy_identities(spark):
    names = ["Acme Builders", "ACME  builders", "acme buildrs", "acme bilders", "Other Co", None, "", "acme builders inc of somewhere"]
    got = {r["key"]: r.asDict() for r in I.fuzzy_identities(spark.createDataFrame([(n,) for n in names], "name string"), 0.85).collect()}
    assert set(got) == {"acme builders", "acme buildrs", "acme bilders", "other co", "acme builders inc of somewhere"}
    assert {k for k, r in got.items() if r["identity"] == "acme builders"} == {"acme builders", "acme buildrs", "acme bilders"}
    assert got["acme builders"]["mentions"] == 4 and got["acme builders"]["variants"] == 3 and got["other co"]["evidence"] == 1.0


def rule(version, word):
    return N.Rule(version, lambda docs: docs.where(F.col("text").contains(word)).select("id", F.lit("t").alias("type"), F.lit("low").alias("severity"), F.col("id").alias("node_a"), F.lit(None).cast("string").alias("node_b"), F.lit(0.5).alias("confidence")))


def test_a_session_equals_full_runs(spark):
    """Changed, new, vanished and null texts, a changed rule and a dropped one; rules see changed documents only."""
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    runs = [
        ([("a", "x"), ("b", "y"), ("c", None), ("d", "x y")], {"one": rule("1", "x"), "two": rule("1", "y")}),
        ([("a", "x"), ("b", "x"), ("c", ""), ("e", "y")], {"one": rule("1", "x"), "two": rule("1", "y")}),
        ([("a", "x"), ("b", "x"), ("c", ""), ("e", "y")], {"one": rule("2", "y"), "three": rule("1", "x")}),
        ([], {"one": rule("2", "y")}),
    ]
    analysed = [{"one": (4, 0, 0), "two": (4, 0, 0)}, {"one": (3, 1, 1), "two": (3, 1, 1)}, {"one": (4, 0, 0), "three": (4, 0, 0)}, {"one": (0, 0, 4)}]
    state = None
    for (rows, rules), want in zip(runs, analysed, strict=True):
        seen = []
        watched = {n: N.Rule(r.version, lambda docs, n=n, r=r: seen.append((n, docs.count())) or r.findings(docs)) for n, r in rules.items()}
        state, report = N.analyze_changes(frame(rows), watched, state)
        full, _ = N.analyze_changes(frame(rows), rules)
        assert Counter(map(tuple, state.findings.collect())) == Counter(map(tuple, full.findings.collect()))
        assert {r["rule"]: (r["analysed"], r["reused"], r["removed"]) for r in report.collect()} == want
        assert dict(seen) == {n: w[0] for n, w in want.items()}


def test_presets(spark):
    hits = spark.createDataFrame([("s", "d", "H", ["H"], 1, "Owner shall test the pump before acceptance.", 1)], "id string, document_id string, heading string, path array<string>, level int, text string, source_number int")
    assert set(N.analyze(hits, "answer", graph=True, context=False)) == set(N.PRESETS["answer"]) - {"context"} | {"graph"}
    full = N.analyze(hits)
    assert set(full) == set(N.PRESETS["full"]) and all(df.columns for df in full.values())
    assert full["requirements"].count() == 1
    with pytest.raises(ValueError):
        N.analyze(hits, nothing=True)


def test_stable_key(spark):
    rows = ['{"a": 1, "b": {"d": [1, {"y": 2, "x": null}], "c": "t"}}', '{"b":{"c":"t","d":[1,{"x":null,"y":2}]},"a":1}', '{"a": 1, "b": {"d": [{"y": 2, "x": null}, 1], "c": "t"}}', "not", None]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string").orderBy("i").select(T.stable_key("p")).collect()]
    assert got[0] == got[1] is not None and got[2] not in (None, got[0]) and got[3] is None and got[4] is None


@pytest.mark.parametrize("carry", [0, 1000])
def test_pairs_of_equal_sets_go_as_one_and_are_not_shuffled(spark, monkeypatch, carry):
    monkeypatch.setattr(P, "MEMBERS", 3)
    monkeypatch.setattr(P, "MEET", 4)
    monkeypatch.setattr(P, "CARRY", carry)
    rnd = random.Random(5)
    rows = [(i, rnd.choice("xy") if i % 9 else None, [f"w{k}" for k in rnd.sample(range(7), rnd.randint(1, 5))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, w array<string>")
    for same in ((), ("k",)):
        fit = [(a, b, len(set(v) & set(w)), v, w) for a, x, v in rows for b, y, w in rows if a < b and set(v) & set(w) and (not same or x == y is not None)]
        p = P.similar_sets(df, F.col("w"), 0.5, same=same)
        want = {(a, b, s) for a, b, s, v, w in fit if s / len({*v, *w}) >= 0.5}
        assert sorted((r.a_id, r.b_id, r.shared) for r in p.collect()) == sorted(want)
        c = P.contained_sets(df, F.col("w"), 0.6, same=same)
        assert sorted((r.a_id, r.b_id, r.shared) for r in c.collect()) == sorted((a, b, s) for a, b, s, v, w in fit if s / min(len(v), len(w)) >= 0.6)
        if carry:
            assert all("Aggregate" not in x._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0] for x in (p, c))  # no distinct of pairs


def test_pairs_of_one_large_set_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "MEMBERS", 4)
    df = spark.createDataFrame([(i, i % 3, ["w"]) for i in range(60)], "id long, k int, w array<string>")
    p = P.similar_sets(df, F.col("w"), 0.5, keep=("k",), apart=(F.col("a_id") < F.col("b_id")) & F.col("same"), also={"same": F.col("a_k") == F.col("b_k")})
    made = [r["n"] for r in p.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sum(made) == 3 * 20 * 19 // 2 and max(made) < sum(made) // 2


@pytest.mark.parametrize(("least", "measure"), [(0.6, "union"), (0.8, "union"), (0.8, "larger"), (1.0, "union")])
def test_long_sets_meet_by_pieces_and_equal_all_pairs(spark, monkeypatch, least, measure):
    """Sets of all sizes, with copies that are changed just so much; few pairs of sets that are not alike are compared."""
    r = random.Random(int(least * 10))
    rows = []
    for i in range(90):
        words = {f"w{int(r.paretovariate(0.6)) % 900}" for _ in range(r.choice([1, 2, 5, 30, 300, 900]))}
        rows.append((len(rows), sorted(words), i % 2))
        for _ in range(r.randrange(3)):
            gone = r.sample(sorted(words), r.randrange(int(len(words) * (1 - least)) + 1))
            rows.append((len(rows), sorted((words - set(gone)) | {f"n{r.random()}" for _ in range(r.randrange(len(gone) + 1))}), i % 2))
    df = spark.createDataFrame(rows, "id int, w array<string>, k int")
    want = {}
    for i, a, k in rows:
        for j, b, m in rows:
            shared, larger = len(set(a) & set(b)), max(len(a), len(b))
            similarity = shared / (larger if measure == "larger" else len(a) + len(b) - shared) if shared else 0
            if i < j and k == m and similarity >= least:
                want[i, j] = (shared, round(similarity, 9))
    monkeypatch.setattr(P, "CARRY", 0)
    seen, real = [], P._by_pieces
    monkeypatch.setattr(P, "_by_pieces", lambda *a: (seen.append(real(*a)), seen[-1])[1])
    got = {(x["a_id"], x["b_id"]): (x["shared"], round(x["similarity"], 9)) for x in P.similar_sets(df, F.col("w"), least, measure=measure, same=("k",)).collect()}
    assert got == want
    assert seen[0].count() <= len(want) + len(rows) ** 2 / 100


def _hits(spark, n=90):
    """Sections of a few texts, most with a number of their own, some with one that another has."""
    says = ["Contractor shall perform testing of goods before acceptance", "The supplier may not deliver goods before testing and acceptance", "Owner must inspect the work unless the owner directs otherwise", "No testing of the work is required before acceptance"]
    rows = [(f"s_{i}", f"d{i % 3}", f"1.{i % 4} Supplier {1000 + i}", f"{says[i % 4]} from Supplier {2000 + (i if i % 5 else i // 2)}.") for i in range(n)]
    return spark.createDataFrame(rows, "id string, document_id string, heading string, text string")


@pytest.mark.parametrize("least, common, measure", [(0.08, None, "union"), (0.45, None, "union"), (0.28, None, "larger"), (None, 3, "union"), (0.5, 4, "union")])
def test_sets_that_differ_in_words_of_their_own_go_as_one(spark, monkeypatch, least, common, measure):
    h = _hits(spark).withColumn("w", T.stem_set(F.concat_ws(" ", "heading", "text"))).select("id", F.col("document_id").alias("k"), "w").cache()
    units, real = [], P._ordered
    monkeypatch.setattr(P, "_ordered", lambda u, *more: (units.append(u.count()), real(u, *more))[1])
    p = P.similar_sets(h, F.col("w"), least, common, measure, keep=("k",))
    got = {(r["a_id"], r["b_id"]): (r["shared"], round(r["similarity"], 9)) for r in p.collect()}
    sets, want = {r["id"]: set(r["w"]) for r in h.collect()}, {}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            sim = both / (len(sets[a] | sets[b]) if measure == "union" else max(len(sets[a]), len(sets[b])))
            if a < b and both and ((least is not None and sim >= least) or (common is not None and both >= common)):
                want[a, b] = (both, round(sim, 9))
    assert got == want and want
    assert units[0] <= 40 < len(sets)


def test_opposing_sources_equal_all_pairs_and_send_few_rows(spark, monkeypatch):
    h = _hits(spark, 160).cache()
    both = F.concat_ws(" ", "heading", "text")
    s = h.select("id", "document_id", T.polarity(both).alias("pol"), T.stem_set(both).alias("s"), T.matches(both, L.EXCEPTION).alias("exc")).collect()
    want = []
    for a in s:
        for b in s:
            common = set(a["s"]) & set(b["s"])
            shared, sim = sum(len(w) >= 4 for w in common), len(common) / len(set(a["s"]) | set(b["s"]))
            if a["id"] < b["id"] and a["document_id"] != b["document_id"] and "neutral" not in (a["pol"], b["pol"]) and (shared >= 3 or sim >= 0.2) and (a["pol"] != b["pol"] or a["exc"] != b["exc"]):
                want.append((-max(50, min(95, int(45 + sim * 100 + min(20, shared * 3) + 0.5))), a["id"], b["id"], shared))
    want.sort()
    rows, real = [], X.similar_sets
    monkeypatch.setattr(X, "similar_sets", lambda df, *more, **how: (rows.append(df.count()), real(df, *more, **how))[1])
    for most in (2, 6, 40):
        got = [(-r["confidence"], r["source_a"], r["source_b"], r["shared"]) for r in X.opposing_sources(h, most).collect()]
        assert got == want[:most] and len(got) == most
    assert rows[0] < len(s) / 2


def test_source_agreement_equals_all_pairs(spark):
    h = _hits(spark, 60)
    sets = {r["id"]: (r["document_id"], set(r["s"])) for r in h.select("id", "document_id", T.stem_set("text").alias("s")).collect()}
    sim = {(a, b): len(x & y) / len(x | y) for a, (d, x) in sets.items() for b, (e, y) in sets.items() if a < b and d != e}
    want = {(a, b, round(v, 6), "agree" if v >= 0.28 else "differ") for (a, b), v in sim.items() if v >= 0.08}
    got = [(r["a"], r["b"], round(r["similarity"], 6), r["verdict"]) for r in X.source_agreement(h, 6).collect()]
    assert len(got) == len(want) and set(got) == want


def test_pairs_of_sets_whose_rows_do_not_fit_are_not_sent(spark, monkeypatch):
    """Rows of five phases with few sets: only parts of neighbouring phases meet, and phase edges equal all pairs."""
    phases = ["submittal", "installation", "inspection", "testing", "acceptance"]
    rows = [(f"r{i:03d}", f"d{i % 2}", f"h{i % 7}", phases[i % 5], f"concrete works number{i % 5} of goods delivered alike{i % 3}") for i in range(200)]
    r = spark.createDataFrame(rows, "requirement_id string, document_id string, heading string, phase string, statement string")
    sent, real = [], P._told
    monkeypatch.setattr(P, "FEW", 1)
    monkeypatch.setattr(P, "_told", lambda p, *more: (sent.append([(x[0][0]["k"], x[1][0]["k"]) for x in p.select("__a", "__b").collect()]), real(p, *more))[1])
    got = [tuple(x) for x in A.phase_edges(r).collect()]
    words, want = {x[0]: set(x[4].split()) - {"of"} for x in rows}, []
    for a in rows:
        for b in rows:
            o = len(words[a[0]] & words[b[0]]) / max(len(words[a[0]]), len(words[b[0]]))
            if phases.index(b[3]) == phases.index(a[3]) + 1 and (a[2] == b[2] or (a[1] == b[1] and o >= 0.12) or o >= 0.28):
                want.append((a[0], b[0], min(100, int(100 * (0.45 + o + 0.2 * (a[2] == b[2]) + 0.1 * (a[1] == b[1])) + 0.5))))
    assert sorted(got) == sorted(want) and want
    assert sum(sent, []) and all(b == a + 1 for a, b in sum(sent, []))


def test_statements_on_things_of_their_own_go_as_one(spark, monkeypatch):
    """Objects that differ in names that no other statement has: few sets, findings as of all pairs."""
    rows = [(f"n{i:03d}", ["owner", "contractor"][i % 2], ["review", "approve"][i % 3 % 2], f"work goods of number{1000 + i}", i % 7 == 0, False, 0.5) for i in range(80)]
    s = spark.createDataFrame(rows, "id string, party string, action string, object string, negated boolean, exclusive boolean, confidence double")
    units, real = [], P._ordered
    monkeypatch.setattr(P, "_ordered", lambda u, *more: (units.append(u.count()), real(u, *more))[1])
    got = RU.responsibility_conflicts(s, 0.4).select("type", "node_a", "node_b").collect()
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                same, other = a[2] == b[2], a[1] != b[1]
                kind = "contradiction" if same and not other and a[4] != b[4] else "double-assignment" if same and other else None if same else "review-approval-split"
                want |= {(kind, a[0], b[0])} if kind else set()
    assert {tuple(x) for x in got} == want and len(got) == len(want) and units == [1]
