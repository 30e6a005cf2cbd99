import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph import registry
from loomgraph.functions import similarity, text
from loomgraph.operators import chunking, extraction, graph_algorithms, hygiene, inference, reasoning, records, resolution, temporal
from loomgraph.registry import Pipeline
from loomgraph.sources import scans, sinks
from loomgraph.sources.arrow_source import scan_arrow, scan_pages, write_arrow
from loomgraph.sources.predicates import dnf, metadata_filter


def graph(spark, pairs, nodes=None):
    ids = nodes or sorted({x for p in pairs for x in p})
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(a, b, "E", 1.0) for a, b in pairs], "src string, dst string, type string, weight double")


def test_star_graph_degree_and_closeness(spark):
    nodes, edges = graph(spark, [("A", "B"), ("A", "C"), ("A", "D"), ("A", "E")])
    assert {r.id: r.score for r in graph_algorithms.degree_centrality(nodes, edges).collect()}["A"] == 1.0
    assert {r.id: r.score for r in graph_algorithms.betweenness(nodes, edges).collect()} == {"A": 6.0, "B": 0.0, "C": 0.0, "D": 0.0, "E": 0.0}
    assert {r.id: round(r.score, 6) for r in graph_algorithms.closeness(nodes, edges).collect()}["B"] == round(4 / 7, 6)


def test_two_components_and_isolated(spark):
    nodes, edges = graph(spark, [("A", "B"), ("C", "D")], ["A", "B", "C", "D", "Z"])
    assert {r.id: r.component for r in graph_algorithms.connected_components(nodes, edges).collect()} == {"A": "A", "B": "A", "C": "C", "D": "C", "Z": "Z"}


def test_paths_and_bridges(spark):
    _, edges = graph(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D")])
    assert graph_algorithms.shortest_path(edges, "A", "D").first().path == ["A", "C", "D"]
    assert [r.path for r in graph_algorithms.k_shortest_paths(edges, "A", "D", 2).orderBy("rank").collect()] == [["A", "C", "D"], ["A", "B", "C", "D"]]
    assert [tuple(r) for r in graph_algorithms.bridges(edges).collect()] == [("C", "D")]


ALLEN = ["before", "after", "meets", "met_by", "equals", "starts", "started_by", "finishes", "finished_by", "overlaps", "overlapped_by", "during", "contains"]


def test_allen_relations_are_exhaustive_and_mirror(spark):
    spans = [(a, b) for a in range(5) for b in range(a + 1, 6)]
    rows = [(*x, *y) for x, y in itertools.product(spans, spans)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    c = [F.col(x) for x in "abcd"]
    got = df.select("a", "b", "c", "d", temporal.allen(*c).alias("r"), temporal.allen(c[2], c[3], c[0], c[1]).alias("m")).collect()
    mirror = dict(zip(ALLEN, ["after", "before", "met_by", "meets", "equals", "started_by", "starts", "finished_by", "finishes", "overlapped_by", "overlaps", "contains", "during"], strict=True))
    assert {r.r for r in got} == set(ALLEN)
    assert all(mirror[r.r] == r.m for r in got)


def test_merge_is_idempotent_and_touching_joins(spark):
    df = spark.createDataFrame([("k", 0, 2), ("k", 2, 3), ("k", 5, 6), ("k", 1, 2)], "key string, start int, end int")
    once = temporal.merge_intervals(df, "key")
    assert sorted((r.start, r.end) for r in once.collect()) == [(0, 3), (5, 6)]
    assert sorted((r.start, r.end) for r in temporal.merge_intervals(once.drop("parts"), "key").collect()) == [(0, 3), (5, 6)]


def test_datalog_parent_and_closure(spark):
    facts = {"parent": spark.createDataFrame([("oak", "elm"), ("elm", "yew")], "a0 string, a1 string")}
    rules = ["ancestor(X, Y) :- parent(X, Y).", "ancestor(X, Z) :- parent(X, Y), ancestor(Y, Z)."]
    known = reasoning.datalog(facts, rules)
    assert sorted(tuple(r) for r in known["ancestor"].collect()) == [("elm", "yew"), ("oak", "elm"), ("oak", "yew")]
    assert reasoning.prove(facts, rules, "ancestor(oak, yew)")
    assert not reasoning.prove(facts, rules, "ancestor(yew, oak)")


def test_metadata_filter_missing_fails_ne(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "id string, k string")
    assert [r.id for r in df.where(metadata_filter([("k", "ne", "x")])).collect()] == ["c"]
    assert [r.id for r in df.where(dnf([[("k", "=", "x")], [("id", "=", "b")]])).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        metadata_filter([("k", "like", "x")])


def test_voting_ties_take_the_first(spark):
    rows = [("e", "p", "red", 2), ("e", "p", "blue", 1), ("e", "q", None, 1)]
    out = resolution.resolve_by_voting(spark.createDataFrame(rows, "entity string, property string, value string, pos int")).collect()
    assert [(r.property, r.value, r.confidence) for r in out] == [("p", "blue", 0.5)]


def test_jaro_winkler_known_values(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("abc", "xyz"), ("", "a")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(similarity.jaro_winkler("a", "b")).collect()] == [0.9611, 0.0, 0.0]


def test_jaro_winkler_counts_whole_transpositions(spark):
    names = [f"supplier#{i:09d}" for i in (12, 120, 201, 1230, 2310, 33077, 37303, 38758, 55537)]
    pairs = [(a, b) for a in names for b in names if a < b]
    found = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity.jaro_winkler("a", "b")).collect()]
    jaro = [duckdb.execute("SELECT jaro_similarity(?, ?)", p).fetchone()[0] for p in pairs]
    assert found == pytest.approx([j + 0.4 * (1 - j) for j in jaro], abs=1e-12)


def test_recursive_closure_passes_the_row_limit_of_recursions(spark):
    edges = spark.range(1, 200).selectExpr("id AS src", "id DIV 2 AS dst")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        found = {tuple(r) for r in reasoning.recursive_closure(spark, edges, 20).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert found == {(i, i >> k) for i in range(1, 200) for k in range(1, i.bit_length() + 1)}


def test_link_scores_of_like_nodes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graph_algorithms, "PART_ROWS", 3)
    pairs = [(f"h{i % 3}", f"leaf{i}") for i in range(30)] + [(h, f"twin{i}") for i in range(8) for h in ("h0", "h1")]
    pairs += [("h0", "h1"), ("h1", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "z"), ("y", "x"), ("p", "q")]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wanted = {}
    for u, v in itertools.combinations(sorted(near), 2):
        both = [len(near[w]) for w in near[u] & near[v]]
        if both and v not in near[u]:
            scores = sum(1 / (d * math.log(d)) for d in both), sum(1 / d for d in both)
            wanted[u, v] = (len(both), len(both) / len(near[u] | near[v]), *scores, len(near[u]) * len(near[v]))
    found = graph_algorithms.link_scores(graph(spark, pairs)[1]).collect()
    assert len(found) == len(wanted)
    for u, v, *scores in found:
        assert scores == pytest.approx(wanted[u, v])


def test_link_scores_shuffle_no_row_for_each_pair_of_leaves(spark):
    sc = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    edges = graph(spark, [("hub", f"leaf{i}") for i in range(300)])[1]
    before = shuffled()
    assert len(graph_algorithms.link_scores(edges).collect()) == 300 * 299 // 2
    assert shuffled() - before < 10_000


def test_link_scores_spread_pairs_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(graph_algorithms, "PART_ROWS", 16)
    monkeypatch.setattr(graph_algorithms, "TASK_ROWS", 1000, raising=False)
    found = graph_algorithms.link_scores(graph(spark, [("hub", f"leaf{i}") for i in range(200)])[1])
    plan = found._jdf.queryExecution().executedPlan()
    spread = plan.toString().split("Exchange")[0]
    assert "Generate" in spread and "Join" not in spread
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 200 * 199 // 2 and max(tasks) < sum(tasks) / 4


def test_link_scores_compile_only_the_inner_loop(spark):
    found = graph_algorithms.link_scores(graph(spark, [("hub", f"leaf{i}") for i in range(50)])[1])
    assert len(found.collect()) == 50 * 49 // 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    loops = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if " Generate explode" in line]
    assert ["*(" in line for line in loops] == [True, False]


def test_chunks_cover_the_text(spark):
    t = "word " * 300
    df = spark.createDataFrame([(t,), ("",), ("short",)], "t string")
    out = [r[0] for r in df.select(chunking.fixed_chunks(F.col("t"), 200, 50)).collect()]
    assert out[1] == [] and [c.text for c in out[2]] == ["short"]
    assert out[0][-1].end == len(t) and all(a.end - b.start == 50 for a, b in zip(out[0], out[0][1:], strict=False))
    rec = [r[0] for r in df.select(chunking.recursive_chunks(100, 0)("t")).collect()]
    assert "".join(c.text for c in rec[0]) == t


def test_text_scalars(spark):
    df = spark.createDataFrame([("<p>A&amp;B</p><script>x</script>", "“Crème”—x…")], "h string, u string")
    row = df.select(text.remove_html(F.col("h")), text.strip_diacritics("u"), text.normalize_punctuation(F.col("u"))).first()
    assert tuple(row) == ("A&B", "“Creme”—x…", '"Crème"--x...')


def test_relations(spark):
    df = spark.createDataFrame([(1, "Acme Corp was founded by Jane Doe. Widget is located in Berlin.")], "id int, t string")
    found = {(r.subject, r.predicate, r.object) for r in extraction.relations(df, "id", "t").collect()}
    assert found == {("Acme Corp", "founded_by", "Jane Doe"), ("Widget", "located_in", "Berlin")}


def test_sparql_union_and_errors(spark):
    t = spark.createDataFrame([("a", "p", "1"), ("b", "q", "2")], "s string, p string, o string")
    s = records.SparqlSubset(t)
    assert sorted(r.x for r in s.select("SELECT ?x WHERE { { ?x p ?y } UNION { ?x q ?y } }").collect()) == ["a", "b"]
    assert s.select("SELECT ?x WHERE { ?x p ?y FILTER(?y >= 2) }").collect() == []
    with pytest.raises(ValueError):
        s.select("DELETE { ?x p ?y }")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id int, name string, score double")
    sinks.write_parquet(df, str(tmp_path / "p"), codec="zstd", partition_by=["name"])
    assert scans.scan_parquet(spark, str(tmp_path / "p"), filters=("name", "=", "b")).count() == 1
    write_arrow(df, str(tmp_path / "x.arrow"))
    assert sorted(map(tuple, scan_arrow(spark, str(tmp_path / "x.arrow"), ["id", "name"]).collect())) == [(1, "a"), (2, "b")]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert scans.scan_csv(spark, str(tmp_path / "c")).count() == 2
    nodes, edges = df.select(F.col("id").cast("string"), F.lit("T").alias("type"), "name"), spark.createDataFrame([("1", "2", "R")], "src string, dst string, type string")
    sinks.ntriples(sinks.graph_triples(nodes, edges)).write.text(str(tmp_path / "nt"))
    assert scans.scan_ntriples(spark, str(tmp_path / "nt")).count() == 5
    assert scan_pages(spark, lambda p: [(p, i) for i in range(3)], 4, "page long, i long").count() == 12
    with pytest.raises(ValueError):
        scans.scan_parquet(spark, str(tmp_path / "p"), limit=-1)


def test_pipeline_order_and_cycle(spark):
    p = Pipeline().add("b", lambda df: df.where("x > 1"), "a").add("a", lambda df: df.withColumn("x", F.col("id") + 1), "source")
    assert p.run(source=spark.range(3))["b"].count() == 2
    with pytest.raises(ValueError):
        Pipeline().add("a", lambda d: d, "b").add("b", lambda d: d, "a").order()


def test_empty_tables(spark):
    nodes, edges = spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string, type string, weight double")
    assert graph_algorithms.connected_components(nodes, edges).count() == 0
    assert graph_algorithms.pagerank(nodes, edges, iterations=2).count() == 0
    assert graph_algorithms.triangles(edges).count() == 0


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_number_and_date_texts(spark):
    from loomgraph.functions import numbers as N

    parsed = {"1,234.5": 1234.5, "12%": 0.12, "3.5K": 3500.0, "$2M": 2e6, "1e3": 1000.0, "abc": None, "-7": -7.0, "0.5B": 5e8}
    assert {x: one(spark, N.parse_number(F.lit(x))) for x in parsed} == pytest.approx(parsed)
    assert one(spark, N.convert_unit(F.lit(3.0), F.lit("mile"), "m")) == pytest.approx(4828.02)
    assert one(spark, N.convert_unit(F.lit(5.0), F.lit("kg"), "m")) is None
    assert [tuple(one(spark, N.parse_currency(F.lit(x)))) for x in ("$1,200.50", "EUR 30", "12.99")] == [(1200.5, "USD"), (30.0, "EUR"), (12.99, "USD")]
    day = F.lit("2024-03-31").cast("date")
    assert str(one(spark, N.relative_date(F.lit("1 month ago"), day))) == "2024-02-29"
    assert one(spark, N.parse_date(F.lit("not a date"))) is None
    assert one(spark, N.period_bounds(F.lit("soon")))[0] is None


def test_leiden_parts_disconnected_communities_and_a_star(spark):
    two = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(4) for j in range(i)]
    nodes, edges = graph(spark, [*two, ("a0", "b0")])
    found = {r.id: r.community for r in graph_algorithms.leiden(nodes, edges).collect()}
    assert len({found[f"a{i}"] for i in range(4)}) == 1 and found["a1"] != found["b1"]
    e = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 4.0), ("a", "b", 1.0), ("b", "t", 1.0), ("a", "t", 9.0)], "src string, dst string, weight double")
    bound = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, h double")
    assert tuple(graph_algorithms.a_star(e, bound, "s", "t").first()) == (["s", "a", "b", "t"], 3.0)
    assert graph_algorithms.a_star(e, bound, "t", "s").isEmpty()


def test_rounds_that_run_out_are_an_error(spark):
    _, edges = graph(spark, [(f"n{i}", f"n{i + 1}") for i in range(12)])
    with pytest.raises(RuntimeError):
        graph_algorithms.shortest_distances(edges, "n0", max_rounds=3)
    assert graph_algorithms.shortest_distances(edges, "n0").count() == 13


def test_recursive_chunks_prefer_coarse_ends_in_the_second_half(spark):
    df = spark.createDataFrame([("aaaa bbbb\ncccc dddd eeee ffff",), ("x" * 25,), ("",), (None,)], "t string")
    got = [[c.text for c in r[0]] for r in df.select(chunking.recursive_chunks(12, 0)("t")).collect()]
    assert got == [["aaaa bbbb\n", "cccc dddd ", "eeee ffff"], ["x" * 12, "x" * 12, "x"], [], []]


def test_ranks_across_bands(spark):
    from loomgraph.operators import retrieval

    scores = [(i, float(i % 7) if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(scores, "id int, score double")
    got = {r.id: r["rank"] for r in retrieval.rank_lists({"x": df}).collect()}
    order = sorted(scores, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: k + 1 for k, (i, _) in enumerate(order)}


def test_decode_falls_back(spark):
    rows = [(1, "café".encode("latin-1")), (2, "café".encode()), (3, b"\xff\xfe" + "hö".encode("utf-16-le")), (4, b""), (5, None)]
    df = spark.createDataFrame(rows, "id int, data binary")
    found = {r["id"]: r["x"] and tuple(r["x"]) for r in df.select("id", hygiene.decode(F.col("data")).alias("x")).collect()}
    assert found == {1: ("ISO-8859-1", False, "café"), 2: ("UTF-8", False, "café"), 3: ("UTF-16LE", True, "hö"), 4: ("UTF-8", False, ""), 5: None}


def test_mail_headers_fold_and_end(spark):
    raw = "From: ann\r\nSubject: Re: FW: Plans\r\n for May\r\nIn-Reply-To: <1>\r\n\r\nSubject: not this\r\n\r\nbye"
    mail = hygiene.parse_mail(spark.createDataFrame([(raw,), ("Subject: alone",), (None,)], "raw string"))
    found = [(r["sender"], r["thread"], r["reply_to"], r["body"]) for r in mail.orderBy(F.desc_nulls_last(F.length("raw"))).collect()]
    assert found[0] == ("ann", "plans for may", "<1>", "Subject: not this\n\nbye")
    assert found[1][:3] == (None, "alone", None) and found[2][:3] == (None, None, None)


def test_clean_keeps_the_least_of_each_key(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, None), ("b", 3, "x"), (" ", 4, "y")], "k string, n int, v string")
    assert sorted(map(tuple, hygiene.clean(df, "k", ["k"], {"v": "none"}, "n").collect())) == [("a", 1, "none"), ("b", 3, "x")]


def test_conclusions_need_all_premises_and_survive_cycles(spark):
    facts = spark.createDataFrame([("p",), ("p",), ("q",)], "statement string")
    rules = spark.createDataFrame([("r1", "s", "p"), ("r1", "s", "q"), ("r2", "t", "s"), ("r2", "t", "missing"), ("r3", "u", "s"), ("r4", "s", "u"), ("r0", "p", "u")], "rule_id string, conclusion string, premise string")
    found = {tuple(r) for r in inference.conclusions(facts, rules).collect()}
    assert found == {("p", 0, None), ("q", 0, None), ("s", 1, "r1"), ("u", 2, "r3")}
    assert inference.conclusions(facts.limit(0), rules).isEmpty()


def test_activations_hold_only_what_is_new(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "a0 string, a1 string")
    old, new = {"e": frame(("a", "b"), ("b", "c"))}, {"e": frame(("c", "d"))}
    found = inference.activations(old, new, "two(X, Z) :- e(X, Y), e(Y, Z).")
    assert {(r["X"], r["Y"], r["Z"]) for r in found.collect()} == {("b", "c", "d")}


def test_temporal_intent_without_a_date_is_empty(spark):
    df = spark.createDataFrame([("who came before noon?",), ("sales since 2020-02-30 in May",)], "q string")
    found = [tuple(r["t"]) for r in df.select(inference.temporal_intent(F.col("q")).alias("t")).collect()]
    assert found == [(None, None, None, None, "who came before noon?"), ("since", None, None, None, "sales in May")]


def test_retries_wait_and_give_up():
    waits, left = [], [RuntimeError("lost"), RuntimeError("lost")]

    def action():
        if left:
            raise left.pop()
        return "done"

    assert registry.retrying(action, attempts=3, first=1.0, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    assert registry.delays(4, 2.0, "linear", most=5.0) == [2.0, 4.0, 5.0]
    with pytest.raises(ValueError):
        registry.retrying(lambda: int("x"), sleep=waits.append)
