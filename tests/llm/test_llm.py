"""The corpus operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import base64
import itertools
import math
import random

import numpy as np
import pytest

from motionlake.llm import grid_clusters, leak, mail, mixing, neighbours, runs, sentences, vectors

STATE = "row_id long, handle string, take int, frame long, flag boolean, mask boolean, start int, run string"


def brute_runs(rows, gap=5):
    out, cur = [], None
    for f, a, m in rows:
        if cur and f - cur["last"] <= gap and all(v is None or w is None or v == w for v, w in ((a, cur["a"]), (m, cur["m"]))):
            cur |= {"last": f, "n": cur["n"] + 1, "a": a if cur["a"] is None else cur["a"], "m": m if cur["m"] is None else cur["m"]}
        else:
            cur = {"first": f, "last": f, "n": 1, "a": a, "m": m}
            out.append(cur)
    return sorted((c["first"], c["last"], c["n"]) for c in out)


def test_runs_equal_the_greedy_rule(spark):
    rng = random.Random(5)
    rows, frame = [], 0
    for _ in range(400):
        frame += rng.choice([1, 1, 1, 2, 5, 6])
        rows.append((frame, rng.choice([True, False, None]), rng.choice([True, True, False, None])))
    data = [(i, "a", 0, *r, 1, "x") for i, r in enumerate(rows)] + [(900 + i, "a", 0, r[0], not r[1], None, 1, "x") for i, r in enumerate(rows[:20])]
    data += [(2000 + i, None, 0, i, True, None, 1, "x") for i in range(3)] + [(3000, "a", 0, None, True, True, 1, "x")]
    rng.shuffle(data)
    df = spark.createDataFrame(data, STATE)
    got = runs.collapse_runs(df, ["handle", "take"], "frame", ["flag", "mask"]).collect()
    assert sorted((r["first"], r["last"], r["n"]) for r in got if r["handle"] == "a") == brute_runs(rows)
    assert [(r["first"], r["last"], r["n"]) for r in got if r["handle"] is None] == [(0, 2, 3)]
    assert runs.collapse_runs(df.limit(0), ["handle", "take"], "frame", ["flag", "mask"]).count() == 0


def test_many_possible_breaks_are_followed_by_doubling(spark):
    rng = random.Random(8)  # a source without a certain break: a contradiction is always to an older row
    rows, last = [], True
    for i in range(3000):
        if i % 2:
            rows.append((i, None, None))
        else:
            last = rng.choice([last, not last])
            rows.append((i, last, None) if rng.random() < 0.7 else (i, None, rng.choice([True, False, None])))
    df = spark.createDataFrame([(i, "a", 0, *r, 1, "x") for i, r in enumerate(rows)] + [(9000 + i, None, 0, *r, 1, "x") for i, r in enumerate(rows[:90])], STATE)
    for most in (4, 10_000):
        got = runs.collapse_runs(df, ["handle", "take"], "frame", ["flag", "mask"], fold_most=most).collect()
        assert sorted((r["first"], r["last"], r["n"]) for r in got if r["handle"] == "a") == brute_runs(rows)
        assert sorted((r["first"], r["last"], r["n"]) for r in got if r["handle"] is None) == brute_runs(rows[:90])


def brute_distance(p, t):
    d = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        n = [i]
        for j in range(1, len(t) + 1):
            n.append(min(d[j] + 1, n[j - 1] + 1, d[j - 1] + (p[i - 1] != t[j - 1])))
        d = n
    return min(d)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 9), (0, 14)))
        assert leak.myers(p, t) == brute_distance(p, t)


def message(body, extra=""):
    return f"From: a@b.example\nContent-Type: text/plain; charset=utf-8\n{extra}\n{body}"


def test_leaks_are_found_in_every_coding(spark):
    item = "The quick brown fox jumps over the lazy dog near an old mill while birds sing about rain"
    dense = "根据鑫焱劦的说法每个淼犇品需要八份垚劦焱才能关闭哪一种骉毳品把鑫鱻磊带到盆地"
    w = item.split()
    twelve, eleven = " ".join(w[2:14]), " ".join(w[2:13])
    typo = twelve.replace("lazy", "lezy")
    coded = base64.b64encode(("x " + twelve.upper()).encode()).decode()
    docs = [
        (1, message("Well. " + twelve + " ok.")), (2, message(eleven)), (3, message(coded, "Content-Transfer-Encoding: base64\n")), (4, message("> " + twelve.replace("over", "over\n> "))),
        (5, message(typo)), (6, None), (7, ""), (8, message("说" + dense[3:15] + "，" + dense[15:30])), (9, message(dense[3:25])), (10, message("Well. " + twelve + " ok.")),
        (11, 'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>' + twelve.replace(" ", "&nbsp;").replace("lazy", "<b>lazy</b>") + "</p>\n--b\nContent-Type: application/octet-stream\n\n" + twelve + "\n--b--\n"),
        (12, 'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: application/octet-stream\n\n' + twelve + "\n--b--\n"), (13, message("pad " * 50_000 + twelve)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y")
    items = spark.createDataFrame([(70, item, "en"), (71, dense, "zh"), (72, None, "en"), (73, "too short", "en"), (74, item, "en")], "item_id long, text string, exact string")
    for block in (5000, 2):
        got = {(r["doc_id"], r["item_id"]): (r["exact"], r["edits"]) for r in leak.find_leaks(d, items, block_items=block).collect()}
        exact = {k for k, v in got.items() if v[0]}
        assert exact == {(i, j) for i in (1, 3, 4, 10, 11, 13) for j in (70, 74)} | {(8, 71)}
        assert got[(5, 70)] == (False, 1) and (9, 71) not in got and (2, 70) not in got
    assert leak.find_leaks(d, items.limit(0)).count() == 0


def test_one_edit_is_found_wherever_it_lies():
    w = [a + b + "xyz" for a in "bcdfg" for b in "aeiou"]
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèàçñøåæ"
    for item, window, glue, edit in ((w, 12, " ", lambda u: u[0] + "q" + u[2:]), (letters, 24, "", lambda u: "0")):
        side = leak._Side([(1, item)], window, 1, glue)
        for at in range(side.piece):
            for e in range(window):
                part = list(item[at : at + window])
                part[e] = edit(part[e])
                units = ["1"] * 9 + part + ["2"] * 9
                assert side.find(units if glue else "".join(units)), (window, at, e)


def test_water_filling():
    got = mixing.water_fill({"a": 100, "b": 100, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 5, "c": 9}, 400)
    assert got["a"] == 100 and got["c"] == 0 and abs(got["b"] - 300) < 1e-9
    assert sum(mixing.water_fill({"a": 10}, {"a": 1.0}, {"a": 2}, 100).values()) == 20


def test_mixture_meets_the_shares(spark):
    rng = random.Random(2)
    data = [(i, s, "word " * rng.randint(1, 60), 1) for i, s in enumerate(["a"] * 800 + ["b"] * 150 + ["c"] * 20)] + [(5000, None, "x", 1), (5001, "a", None, 1), (5002, "z", "x", 1), (5003, "a", "", 1)]
    d = spark.createDataFrame(data, "doc_id long, source string, text string, copies int")
    t = spark.createDataFrame([("a", 0.4, 3), ("b", 0.4, 4), ("c", 0.1, 2), ("none", 0.1, None)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(d, t)
    r = {x["source"]: x for x in mixing.report(m, t).collect()}
    assert r["none"]["tokens"] == 0 and r["c"]["most_copies"] == 2
    assert r["b"]["most_copies"] <= 4 and abs(r["a"]["actual_share"] - r["b"]["actual_share"]) < 0.005
    assert m.filter("doc_id >= 5000").count() == 0 and sorted(m.collect()) == sorted(mixing.mixture(d, t).collect())
    assert mixing.mixture(d.limit(0), t).count() == 0


SENTENCES = [
    "Dr. Ruskin saw Mr. Able at 3.5 mm, i.e. the lens is fine.", "We met at 9 p.m. ", "The board moved! ", '"Is it ready?" asked Ann. ', "He shouted \"Stop!\" and left. ", "Well ... it works. ", "See fig. 4 and sec. 9.9 for more?! ",
    "It was bought by Lumen Inc. ", "The drive is full… ", "(It is odd that it works.) ", "Open run_2.v2.csv and mail a.b@c.example if needed. ",
]


def test_sentences(spark):
    head = "Content-Type: text/plain; charset=utf-8\n\n"
    text = head + "Dear all,\n\n" + "".join(s if s.endswith(" ") else s + " " for s in SENTENCES) + "\n> quoted. No.\n- One item\n  goes on. Two.\n2. Next\n\n真的吗？！“好了。我们等着。”Ann这样写道。新的镜头打不开\n\n-- \nSig. Nature.\n"
    filler = head + "the board is by the drive. the team met, the lens moved. He saw Mr. Zed and Mr. Quu. Mr. Foo came. Of Dr. Moo and Dr. Goo, Dr. Poo won. see fig. 5, see sec. 3 here.\n\nLumen Inc.\n\nat 9 p.m.\n"
    d = spark.createDataFrame([(1, text), (2, filler), (3, None), (4, ""), (5, "no body"), (1, text)], "doc_id long, text string")
    out = sentences.split_sentences(d, plain_only=True)
    got = sorted({(r["sent_start"], r["sentence"]) for r in out.filter("doc_id = 1").collect()})
    body = [s.strip() for s in SENTENCES]
    assert [s for _, s in got] == ["Dear all,", *body, "- One item\n  goes on.", "Two.", "2. Next", "真的吗？！", "“好了。我们等着。”Ann这样写道。", "新的镜头打不开"]
    assert all(text[a : a + len(s)] == s for a, s in got)
    joined = sentences.split_sentences(d, plain_only=True, send_most=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, out.collect()))
    assert sentences.split_sentences(d.limit(0)).count() == 0


def test_joined_counts_decide_like_sent_counts(spark):
    head = "Content-Type: text/plain; charset=utf-8\n\n"
    filler = head + "ask etc. and go, see Prof. a day, Univ. of it, 교수. 3 und 교수. 4 oder 교수. 5 hier, " * 3 + "then the lens and the drive moved, the end was a place.\n"
    texts = [head + t + "\n" for t in ("Pens etc. The rest is here.", "He saw Prof. Zed there.", "At Univ. The lens broke.", "그 교수. 누가 왔다.", "东京。Univ. The end.", "„It is etc.“ The lens moved.")]
    d = spark.createDataFrame(list(enumerate([filler, filler, *texts])), "doc_id long, text string")
    sent, joined = (sorted(map(tuple, sentences.split_sentences(d, send_most=n).collect())) for n in (10_000, 0))
    assert joined == sent
    assert [r[5] for r in sent if r[0] == 2] == ["Pens etc.", "The rest is here."]


def test_mail_parts_survive_truncation():
    enc = base64.b64encode("héllo wörld, this goes on".encode()).decode()[:-5]
    t = f'Content-Type: multipart/alternative;\r\n boundary="x"\r\n\r\n--x\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\n{enc}'
    assert [p[:11] for p in mail.text_parts(t)] == ["héllo wörld"]


def cloud(seed=0, groups=12, per=14, loose=300, dim=16):
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal((loose, dim))]
    for g in range(groups):
        c = rng.standard_normal(dim)
        x.append(c / np.linalg.norm(c) + 0.045 * rng.standard_normal((per * (20 if g == 0 else 1), dim)))
    x = np.concatenate(x)
    near = x[rng.choice(len(x), 40)] * 3 + 0.001 * rng.standard_normal((40, dim))
    return np.concatenate([x, near, x[:20]])


@pytest.fixture(scope="module")
def table(spark):
    x = cloud()
    data = [(i, "a", i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(9000, "a", 0, [1.0] * 16), (9001, "a", 9001, None), (9002, "a", 9002, [0.0] * 16), (9003, "a", 9003, [float("nan")] * 16), (9004, "a", 9004, [1.0] * 15)]
    df = spark.createDataFrame(data, "row_id long, handle string, frame long, data array<double>")
    return x, vectors.usable_vectors(df, ["handle", "frame"], "row_id", "data", 16)


def test_similar_pairs_equal_brute_force(spark, table):
    x, v = table
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if s[i, j] >= 0.99}
    got = [(r["row_id_a"], r["row_id_b"]) for r in neighbours.similar_pairs(v, 0.99, 16).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.98 * len(want)
    assert neighbours.similar_pairs(v.limit(0), 0.99, 16).count() == 0


def test_full_buckets_lose_nothing(spark, table):
    _, v = table
    x = vectors.sample(v, 16)
    got = []
    for rows in (4096, 8):
        coder = neighbours.Coder(x, 16, len(x), 0.99, bucket_rows=rows)
        assert bool(coder.hot) == (rows == 8)
        got.append(sorted(map(tuple, neighbours.bucket_pairs(v, spark.sparkContext.broadcast(coder), 16, 0.99, 64).collect())))
    assert got[0] and got[0] == got[1]


def test_substrings_hold_the_pigeonhole_guarantee():
    rng = np.random.default_rng(6)
    for n in (15_000, 150_000, 15_000_000, 1_000_000_000):
        coder = neighbours.Coder(np.zeros((0, 48)), 48, n, 0.99)
        cuts = coder.cuts[0]
        bits = cuts[-1][1]
        radius = neighbours.radius_for(bits, math.acos(0.99) / math.pi)
        assert len(cuts) == radius + 1 and all(a < b for a, b in cuts) and cuts[0][0] == 0
        a = rng.standard_normal((3000, 48))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        o = rng.standard_normal((3000, 48))
        o -= (o * a).sum(1, keepdims=True) * a
        b = 0.99 * a + math.sqrt(1 - 0.99**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
        (_, _, ka), (_, _, kb) = (next(iter(coder.keys(v))) for v in (a, b))
        code = [np.concatenate([v @ r > 0 for r in coder.rotations], axis=1)[:, :bits] for v in (a, b)]
        within, met = (code[0] != code[1]).sum(axis=1) <= radius, (ka == kb).any(axis=1)
        print(f"{n} rows: {bits} bits, {len(cuts)} tables, radius {radius}, met at the threshold {met.mean():.4f}")
        assert met[within].all() and met.mean() >= 0.997


def test_modes_meet_pairs_at_the_threshold():
    rng = np.random.default_rng(9)
    c = rng.standard_normal(48)
    c /= np.linalg.norm(c)

    def around(n):
        x = c + 0.034 * rng.standard_normal((n, 48))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    sample = np.concatenate([around(4000), rng.standard_normal((6000, 48))])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    for n in (15_000, 1_000_000, 100_000_000):
        coder = neighbours.Coder(sample, 48, n, 0.99)
        a = around(2000)
        o = rng.standard_normal((2000, 48))
        o -= (o * a).sum(1, keepdims=True) * a
        b = 0.99 * a + math.sqrt(1 - 0.99**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
        met = np.zeros(2000, bool)
        both = [{j: (rows, keys) for j, rows, keys in coder.keys(v)} for v in (a, b)]
        for j in both[0].keys() & both[1].keys():
            (ra, ka), (rb, kb) = both[0][j], both[1][j]
            at = np.intersect1d(ra, rb)
            met[at] |= (ka[np.searchsorted(ra, at)] == kb[np.searchsorted(rb, at)]).any(axis=1)
        print(f"{n} rows: {len(coder.modes)} mode, {len(coder.cuts[1])} tables of {coder.cuts[1][0][1]} bits, met {met.mean():.4f}")
        assert len(coder.modes) == 1 and met.mean() >= 0.99


def test_classes_count_links_between_different_vectors(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(100, [1.0, 2.0, 3.0, 4.01]), (101, [4.0, -1.0, 0.0, 0.0])], "row_id long, v array<double>")
    got = {r["row_id"]: (r["class_id"], r["copies"], r["links"]) for r in neighbours.similar_classes(v, 0.99, 4).collect()}
    assert got == {i: (0, 30, 1) for i in range(30)} | {100: (100, 1, 1), 101: (101, 1, 0)}


def test_copies_are_linked_once(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(100, [1.0, 2.0, 3.0, 4.01])], "row_id long, v array<double>")
    got = {(r["row_id_a"], r["row_id_b"]) for r in neighbours.similar_pairs(v, 0.99, 4).collect()}
    assert got == {(0, i) for i in range(1, 30)} | {(0, 100)}


def test_nearest_recall(spark, table):
    x, v = table
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in neighbours.nearest(v, v.filter("row_id % 20 = 0"), 5, 16).collect():
        got.setdefault(r["query_id"], []).append(s[r["query_id"], r["row_id"]])
    assert set(got) == {i for i in range(len(x)) if i % 20 == 0}
    hits = sum(c >= np.sort(s[q])[-5] - 1e-6 for q, cs in got.items() for c in cs)
    assert hits >= 0.9 * 5 * len(got)


def test_groups_equal_brute_force(spark, table):
    x, v = table
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.87
    want, seen = set(), set()
    for i in range(len(x)):
        m = np.flatnonzero(s[i])
        if i not in seen and len(m) >= 8 and s[np.ix_(m, m)].all() and all(set(np.flatnonzero(s[j])) == set(m) for j in m):
            want |= {(int(m[0]), int(j)) for j in m}
            seen |= set(m)
    members = grid_clusters.cluster(v, 16)
    got = {(r["cluster_row_id"], r["row_id"]) for r in members.collect()}
    assert want and got == want
    about = grid_clusters.describe(members).collect()
    assert sum(r["size"] for r in about) == len(want) and all(r["typical"] for r in about)
    assert grid_clusters.cluster(v.limit(0), 16).count() == 0


def brute_groups(x, all_pairs=0.87, least=8):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [frozenset(np.flatnonzero(r).tolist()) for r in u @ u.T >= all_pairs]
    return {(min(g), i) for g in set(near) if len(g) >= least and all(near[j] == g for j in g) for i in g}


def test_groups_do_not_depend_on_the_grids_that_link(spark, table):
    x, _ = table
    first = x[300] / np.linalg.norm(x[300])  # a row of the large group; the new row is out at just over the threshold
    away = np.linalg.svd(x[300:580])[2][-1]
    x = np.concatenate([x, [0.88 * first + math.sqrt(1 - 0.88**2) * (away - away @ first * first)]])
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "row_id long, v array<double>")
    want = brute_groups(x)
    assert want and not any(300 <= i < 580 for _, i in want)
    assert {(r["cluster_row_id"], r["row_id"]) for r in grid_clusters.cluster(v, 16, grids=2).collect()} == want


def test_rows_just_under_the_threshold_join_nothing(spark):
    rng = np.random.default_rng(4)

    def at(cosine, a, b):
        return cosine * np.eye(16)[a] + math.sqrt(1 - cosine**2) * np.eye(16)[b]

    angle = math.acos(0.865)
    apart = [np.cos(t) * np.eye(16)[4] + np.sin(t) * np.eye(16)[5] for t in (0, 2 * angle)]
    x = [at(1, 0, 1)] * 9 + [at(0.865, 0, 1)] + [apart[0]] * 8 + [np.cos(angle) * np.eye(16)[4] + np.sin(angle) * np.eye(16)[5]] + [apart[1]] * 10
    # a group at pairwise 0.885, where the quantised vectors decide nothing
    loose = math.sqrt(0.885) * np.eye(16)[8] + math.sqrt(0.115) * np.linalg.qr(rng.standard_normal((7, 7)))[0] @ np.eye(16)[9:]
    x = np.concatenate([np.array(x) + 1e-5 * rng.standard_normal((len(x), 16)), loose, [loose[0] + 1e-4]])
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "row_id long, v array<double>")
    want = brute_groups(x)
    assert {c for c, _ in want} == {0, 10, 19, 29}
    assert {(r["cluster_row_id"], r["row_id"]) for r in grid_clusters.cluster(v, 16).collect()} == want


def test_smallest_groups_are_linked_whatever_the_number_of_rows():
    rng = np.random.default_rng(8)
    few = 0
    for n in (15_000, 150_000, 15_000_000, 1_000_000_000):
        axes = grid_clusters.axes_for(n, 48)
        number = grid_clusters.grids_needed(axes, 0.87, 8)
        assert few <= number < grid_clusters.MOST_GRIDS
        few = number
        grids = grid_clusters.Grids(48, axes, number, np.zeros((0, 48)), 0)
        kept = 0
        for _ in range(60):  # 8 rows with all pairs at 0.88
            basis = np.linalg.qr(rng.standard_normal((48, 9)))[0].T
            x = math.sqrt(0.88) * basis[0] + math.sqrt(0.12) * basis[1:]
            linked = np.eye(8)
            for g in range(number):
                c = grids.cells(x, g)
                linked += c[:, None] == c[None, :]
            kept += (np.linalg.matrix_power(np.minimum(linked, 1), 8) > 0).sum(axis=1).max() >= grid_clusters.seed_rows(8)
        print(f"{n} rows: {axes} axes, {number} grids, {kept} of 60 groups found")
        assert kept >= 59


def test_hot_cells_in_parts_give_the_same_groups(spark, table, monkeypatch):
    x, v = table
    monkeypatch.setattr(grid_clusters, "PART_ROWS", 16)
    assert grid_clusters.Grids(16, 4, 3, x / np.linalg.norm(x, axis=1, keepdims=True), len(x)).hot
    want = brute_groups(x)
    assert want and {(r["cluster_row_id"], r["row_id"]) for r in grid_clusters.cluster(v, 16).collect()} == want


def test_first_reached_by_tiles_equals_the_plain_way(monkeypatch):
    x = cloud(3).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(grid_clusters, "TILE", 7)
    label, cosine = grid_clusters.first_reached(x, 0.87)
    firsts = []
    for i in range(len(x)):
        hit = [f for f in firsts if x[f] @ x[i] >= 0.87]
        firsts += [] if hit else [i]
        assert label[i] in (hit or [i]) and abs(cosine[i] - x[i] @ x[label[i]]) < 1e-5
    assert len(firsts) == len(set(label))


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 8), (3, 3)]
    got = {r["node"]: r["label"] for r in vectors.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k >= 100} == {100} and {got[k] for k in (7, 8, 9)} == {7}
