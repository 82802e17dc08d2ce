"""JSON lines, builder, corrections, nested tables, events, streaming."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from phraseloom.operators import builder, lexicon, nested, reclassify
from phraseloom.sources import jsonl
from phraseloom.streaming import events

GOOD = {"id": 3000000001, "phrase": "so to say", "categories": ["x"], "pos": "adv", "definition": None, "tags": [], "elements": [["w", "so"], ["w", "to"], ["w", "say"]]}
LINES = [
    (json.dumps(GOOD), True),
    (json.dumps(GOOD | {"extra": {"a": 1}}), True),
    (json.dumps({k: GOOD[k] for k in ("id", "phrase", "elements")}), True),
    (json.dumps(GOOD | {"elements": [["w"], ["slot"]]}), True),
    (json.dumps(GOOD | {"elements": []}), True),
    (json.dumps(GOOD | {"elements": [["verb", "x"]]}), False),
    (json.dumps(GOOD | {"elements": [[]]}), False),
    (json.dumps(GOOD | {"elements": None}), False),
    (json.dumps(GOOD | {"id": -1}), False),
    (json.dumps(GOOD | {"id": 2**32}), False),
    (json.dumps(GOOD | {"id": 4294967295}), True),
    (json.dumps(GOOD | {"id": "7"}), False),
    (json.dumps(GOOD | {"id": 7.5}), False),
    (json.dumps(GOOD | {"phrase": None}), False),
    (json.dumps(GOOD | {"phrase": 5}), False),
    (json.dumps(GOOD | {"categories": None}), False),
    (json.dumps(GOOD | {"categories": "x"}), False),
    (json.dumps(GOOD | {"categories": ["x", None]}), False),
    (json.dumps(GOOD | {"tags": [1]}), False),
    (json.dumps(GOOD | {"pos": 3}), False),
    ("", False),
    ("   ", False),
    ("{", False),
    ("[1]", False),
    ("null", False),
    (None, False),
]


def test_lexicon_lines_are_taken_whole_or_dropped(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(LINES)], "n int, line string")
    kept = {r.n for r in jsonl.parse_lexicon(df).collect()}
    assert kept == {i for i, (_, ok) in enumerate(LINES) if ok}


def test_wiki_lines(spark):
    cases = [
        ({}, True), ({"word": None, "senses": None}, True), ({"word": "a", "senses": [{}]}, True), ({"senses": [{"glosses": ["x"], "tags": None}]}, True),
        ({"word": 1}, False), ({"senses": [1]}, False), ({"senses": [None]}, False), ({"senses": [{"tags": [1]}]}, False), ({"senses": {}}, False), ({"categories": [None]}, False),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "n int, line string")
    assert {r.n for r in jsonl.parse_wiki(df).collect()} == {i for i, (_, ok) in enumerate(cases) if ok}


def test_files_in_order(spark, tmp_path):
    entry = lambda i, p: json.dumps(GOOD | {"id": i, "phrase": p})
    main, custom = tmp_path / "main.jsonl", tmp_path / "custom.jsonl"
    main.write_text("\n".join(["", entry(5, "a"), "junk", entry(3, "b"), json.dumps(GOOD | {"id": 1, "elements": [["w", "one"]]})]) + "\n")
    custom.write_text(entry(4, "c") + "\n")
    load = lambda *a: [(r.entry_idx, r.id) for r in lexicon.load(spark, *map(str, a)).orderBy("entry_idx").collect()]
    assert load(main, custom) == [(0, 5), (1, 3), (2, 4)]
    assert load(main, tmp_path / "missing.jsonl") == [(0, 5), (1, 3)] == load(main)
    with pytest.raises(Exception):
        load(tmp_path / "missing.jsonl")


def test_lexicon_round_trip_writes_nulls(spark, tmp_path):
    df = jsonl.parse_lexicon(spark.createDataFrame([(json.dumps(GOOD),)], "line string"))
    jsonl.write_lexicon(df, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first().value
    assert list(json.loads(line)) == ["id", "phrase", "categories", "pos", "definition", "tags", "elements"] and json.loads(line) == GOOD


def test_corrections_last_line_wins_and_append(spark, tmp_path):
    rows = [(1, '{"id": 1, "categories": ["a"]}'), (2, '{"id": 1, "categories": ["b"]}'), (3, '{"id": 2}'), (4, "x"), (5, '{"id": 9, "categories": []}')]
    fixes = jsonl.parse_corrections(spark.createDataFrame(rows, "n int, line string"), ["n"])
    entries = spark.createDataFrame([(1, ["old"], 0), (1, ["old2"], 1), (2, ["keep"], 2), (9, ["gone"], 3)], "id bigint, categories array<string>, k int")
    out = {r.k: r.categories for r in lexicon.apply_corrections(entries, fixes).collect()}
    assert out == {0: ["b"], 1: ["b"], 2: ["keep"], 3: []}
    for _ in range(2):
        jsonl.append_corrections(fixes, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 4


def test_builder_rules(spark):
    config = builder.BuilderConfig({"English idioms": "idiom", "English multiword terms": "fixed_collocation"}, "en", {"fixed_collocation": ["verb"]}, ["the house"])
    sense = lambda cats, glosses=(), tags=(): {"categories": cats, "tags": list(tags), "glosses": list(glosses)}
    rows = [
        (1, "kick the bucket", "verb", "en", None, [sense(["Other"], ["no"]), sense(["English idioms with x"], ["to die"], ["b", "a"])]),
        (2, "kick the bucket", "verb", "en", ["English idioms"], None),  # later line of the same headword
        (3, "kick  it out", "noun", "en", ["English multiword terms"], []),  # type dropped by part of speech
        (4, "old hand", "noun", "en", ["English idioms"], [sense(["English multiword terms"], ["gloss kept"])]),
        (5, "the house", "noun", "en", ["English idioms"], []),
        (6, "in the", "prep", "en", ["English idioms"], []),  # no content word
        (7, "someone's cat", "noun", "en", ["English idioms"], []),  # one fixed word
        (8, "big deal", "noun", None, ["English idioms"], []),
        (9, "word", "noun", "en", ["English idioms"], []),
        (10, "big idea", "noun", "en", ["English idiomsx", None], []),
    ]
    df = spark.createDataFrame(rows, "n int, word string, pos string, lang_code string, categories array<string>, " + jsonl.WIKI_SCHEMA.split(", ", 4)[-1])
    out = {r.phrase: r for r in builder.build(df, config, ["n"]).collect()}
    assert set(out) == {"kick the bucket", "old hand"}
    assert (out["kick the bucket"].n, out["kick the bucket"].definition, out["kick the bucket"].tags) == (1, "to die", ["a", "b"])
    assert (out["old hand"].categories, out["old hand"].definition) == (["idiom"], "gloss kept")
    assert builder.build_stats(df, config, ["n"]).first() == (10, 2, 2)
    assert builder.build(df.where("n < 0"), config, ["n"]).count() == 0


def test_builder_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('input_file = "x"\nlang_code = ""\n[target_categories]\n"A" = "b"\n[pos_filter]\nb = ["verb"]\n')
    config = builder.BuilderConfig.from_toml(str(path))
    assert (config.lang_code, dict(config.target_categories), config.input_file) == ("", {"A": "b"}, "x")
    assert len(builder.DEFAULT_CONFIG.phrase_blocklist) == 27


def test_retries():
    calls, slept = [], []

    def ask(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("http 503")
        return "ok"

    assert reclassify.with_retries(ask, "p", (2, 4, 8, 16), slept.append) == "ok" and slept == [2, 4]
    with pytest.raises(RuntimeError):
        reclassify.with_retries(lambda p: (_ for _ in ()).throw(RuntimeError("http 400")), "p", (2,), slept.append)
    tries = []
    with pytest.raises(RuntimeError):
        reclassify.with_retries(lambda p: (tries.append(1), (_ for _ in ()).throw(RuntimeError("429")))[1], "p", (1, 1, 1, 1), lambda s: None)
    assert len(tries) == 5


def test_classify_and_relabel(spark):
    entries = spark.createDataFrame([(i, f"p {i}", None, ["idiom", "fixed_collocation"], i) for i in range(120)], "id bigint, phrase string, definition string, categories array<string>, k int")
    batched = reclassify.batches(entries, ["k"])
    prompts = reclassify.prompts(batched)
    assert sorted(r.batch for r in prompts.collect()) == [0, 1, 2]

    def ask(prompt):
        import json as j
        import re

        ids = [int(x) for x in re.findall(r"id=(\d+)", prompt)]
        return j.dumps({"candidates": [{"content": {"parts": [{"text": j.dumps({"results": [{"id": i, "kind": "fixed" if i % 2 else "idiom"} for i in ids]})}]}}]})

    answers = reclassify.classify(prompts, ask)
    labels = answers.select(F.explode(reclassify.labels_of(F.col("answer"))).alias("l")).select("l.*")
    out = {r.id: (r.categories, r.reclassified) for r in reclassify.relabel(entries, labels.where("id < 100")).collect()}
    assert out[1] == (["fixed_collocation"], True) and out[2] == (["idiom", "fixed_collocation"], False) and out[101] == (["idiom", "fixed_collocation"], False)


def test_reclassification_resumes(spark, tmp_path):
    entries = spark.createDataFrame([(i, f"p {i}", None, ["idiom"] if i % 3 else ["proverb"], i) for i in range(90)], "id bigint, phrase string, definition string, categories array<string>, k int")

    def ask(prompt):
        import json as j
        import re

        ids = [int(x) for x in re.findall(r"id=(\d+)", prompt)]
        return j.dumps({"candidates": [{"content": {"parts": [{"text": j.dumps({"results": [{"id": i, "kind": "fixed"} for i in ids if i % 2]})}]}}]})

    path = str(tmp_path / "corrections")
    assert tuple(reclassify.run(entries.where("id < 60"), path, ask, ["k"]).first()) == (40, 20, 1)
    assert tuple(reclassify.run(entries, path, ask, ["k"]).first()) == (20, 10, 1)
    assert tuple(reclassify.run(entries, path, ask, ["k"]).first()) == (0, 0, 0)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(lines) == len({x["id"] for x in lines}) == 60 and {tuple(x["categories"]) for x in lines if x["id"] % 2} == {("fixed_collocation",)}


def test_last_label_of_the_own_batch_holds(spark):
    entries = spark.createDataFrame([(5, ["idiom"], 0), (5, ["idiom"], 1), (6, ["idiom"], 0), (7, ["idiom", "x", "idiom"], 1)], "id bigint, categories array<string>, batch bigint")
    labels = [(0, 5, "idiom", 0), (0, 5, "fixed", 1), (1, 5, "fixed", 0), (1, 5, "idiom", 1), (1, 6, "fixed", 2), (0, 99, "fixed", 3), (1, 7, "fixed", 4)]
    out = reclassify.relabel(entries, spark.createDataFrame(labels, "batch bigint, id bigint, kind string, place int"), "place")
    assert sorted((r.id, r.categories, r.reclassified) for r in out.collect()) == [
        (5, ["fixed_collocation"], True), (5, ["idiom"], False), (6, ["idiom"], False), (7, ["fixed_collocation", "x"], True)
    ]


def test_no_answered_batch_is_asked_again(spark, tmp_path):
    """The third batch fails: what was answered is there, and a second run asks for the rest only."""
    entries = spark.createDataFrame([(i, f"p {i}", None, ["idiom"], i) for i in range(190)], "id bigint, phrase string, definition string, categories array<string>, k int")
    calls, broken, path = str(tmp_path / "calls"), str(tmp_path / "broken"), str(tmp_path / "corrections")
    open(broken, "w").close()

    def ask(prompt):
        import json as j
        import os
        import re

        ids = [int(x) for x in re.findall(r"id=(\d+)", prompt)]
        if ids[0] == 100 and os.path.exists(broken):
            raise RuntimeError("http 400")
        with open(calls, "a") as f:
            f.write(f"{ids[0]}\n")
        return j.dumps({"candidates": [{"content": {"parts": [{"text": j.dumps({"results": [{"id": i, "kind": "fixed"} for i in ids]})}]}}]})

    with pytest.raises(RuntimeError, match="batch 2: RuntimeError: http 400"):
        reclassify.run(entries, path, ask, ["k"], flush_batches=2)
    assert spark.read.text(path).count() == 140  # the fourth batch was in the wave of the third
    (tmp_path / "broken").unlink()
    assert tuple(reclassify.run(entries, path, ask, ["k"], per_minute=100000).first()) == (50, 50, 1)
    assert sorted(int(x) for x in open(calls).read().split()) == [0, 50, 100, 150] and spark.read.text(path).count() == 190


def test_http_classifier():
    """Request and response over a local server; status codes show in errors, so busy servers are asked again."""
    import http.server
    import threading

    from phraseloom.sources.http_model import HttpClassifier

    seen, codes = [], [503, 200, 400]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["content-length"])))))
            self.send_response(codes.pop(0))
            self.end_headers()
            self.wfile.write(b'{"candidates": []}')

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    env = {"LLM_API_KEY": "k", "LLM_MODEL": "m", "LLM_RPM": " 30 ", "LLM_URL": f"http://127.0.0.1:{server.server_port}/v1/{{model}}?key={{key}}"}
    ask = HttpClassifier.from_env("LLM_", env)
    assert ask.per_minute == 30 and HttpClassifier.from_env("LLM_", env | {"LLM_RPM": "x"}).per_minute == 0
    assert reclassify.with_retries(ask, "which?", (1,), lambda s: None) == '{"candidates": []}'
    assert seen[0][0] == "/v1/m?key=k" and seen[1][1]["contents"][0]["parts"][0]["text"] == "which?" and seen[0][1]["generationConfig"]["temperature"] == 0
    with pytest.raises(RuntimeError, match="http 400"):
        reclassify.with_retries(ask, "which?", (1,), lambda s: None)
    server.shutdown()
    with pytest.raises(ValueError, match="API_KEY"):
        HttpClassifier.from_env("LLM_", {})


def test_unreadable_answers_are_errors(spark, tmp_path):
    entries = spark.createDataFrame([(1, "p", None, ["idiom"], 1)], "id bigint, phrase string, definition string, categories array<string>, k int")
    with pytest.raises(RuntimeError, match="batch 0: no labels in the answer: sorry"):
        reclassify.run(entries, str(tmp_path / "c"), lambda p: "sorry", ["k"])
    assert spark.read.text(str(tmp_path / "c")).count() == 0


def test_numbering_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.n for r in lexicon.numbered(df, ["k"], "n").collect())


SENSES = "entry_id bigint, tag string, senses array<struct<categories:array<string>,glosses:array<string>>>"


def test_nested(spark):
    rows = [(1, "x", [(["c"], ["a", None, ""]), None, ([], None)]), (2, "y", None), (3, "z", []), (1, "x", [(["c"], ["a", None, ""]), None, ([], None)])]
    df = spark.createDataFrame(rows, SENSES)
    tagged = nested.emit_tagged(df, "entry_id", {"senses": "sense", "senses.glosses": "gloss"})
    got = sorted((r.tag, r.root_id, tuple(r.positions), r.parent_tag) for r in nested.once(tagged).collect())
    assert got == [("gloss", 1, (0, 0), "sense"), ("gloss", 1, (0, 2), "sense"), ("sense", 1, (0,), "root"), ("sense", 1, (2,), "root")]
    assert tagged.count() == 8
    only = nested.emit_tagged(df, "entry_id", {"senses.glosses": "gloss"}, payload=False)
    assert {(r.tag, r.parent_tag) for r in only.collect()} == {("gloss", "root")}
    assert nested.emit_tagged(df.where("false"), "entry_id", {"senses": "sense"}).count() == 0


def test_nested_tables_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, [(1, "a", [[1, 2], None, []]), (2, None, None)])], "id bigint, items array<struct<n:int,s:string,grid:array<array<int>>>>")
    tagged = nested.emit_tagged(df, "id", {"items": "item", "items.grid": "row", "items.grid.element": "cell"})
    nested.write_tables(tagged, str(tmp_path / "t"))
    items = nested.read_table(spark, str(tmp_path / "t"), "item", "n int, s string", 1)
    assert sorted(items.collect()) == [(1, 0, 1, "a"), (1, 1, 2, None)]
    cells = nested.read_table(spark, str(tmp_path / "t"), "cell", "value int", 3)
    assert sorted(cells.collect()) == [(1, 0, 0, 0, 1), (1, 0, 0, 1, 2)]
    assert nested.read_table(spark, str(tmp_path / "t"), "row", "value string", 2).count() == 2


def test_nested_loses_nothing(spark):
    """Arrays in structs, arrays without a table, the record's own row; unknown paths are an error."""
    kind = "id int, root_id string, senses array<struct<in:struct<xs:array<int>,n:int>,tags:array<string>,w:string>>, other array<string>"
    df = spark.createDataFrame([(7, "r", [(([1, None, 3], 5), ["t"], "a"), (None, None, None)], ["o"])], kind)
    tagged = nested.emit_tagged(df, "id", {"senses": "sense", "senses.in.xs": "x"}, root_tag="record")
    got = {(r.tag, tuple(r.positions)): (r.parent_tag, json.loads(r.payload)) for r in tagged.collect()}
    assert got == {
        ("record", ()): (None, {"id": 7, "root_id": "r", "other": ["o"]}),
        ("sense", (0,)): ("record", {"in": {"n": 5}, "tags": ["t"], "w": "a"}),
        ("sense", (1,)): ("record", {"in": None, "tags": None, "w": None}),
        ("x", (0, 0)): ("sense", {"value": 1}),
        ("x", (0, 2)): ("sense", {"value": 3}),
    }
    with pytest.raises(ValueError, match="senses.no"):
        nested.emit_tagged(df, "id", {"senses.no": "x"})
    with pytest.raises(ValueError, match="senses.in"):
        nested.emit_tagged(df, "id", {"senses.in": "x"})
    twice = nested.distinct_records(df.unionByName(df), "id", ["senses"])
    assert nested.emit_tagged(twice, "id", {"senses.tags": "t"}).count() == 1


REQUESTS = "request_id string, results array<struct<result:string,error:string>>"


def test_events(spark):
    rows = [("a", [("1", None), ("2", None), ("3", None)]), ("b", []), ("c", None), ("d", [("1", None), ("2", "oops"), ("3", None)])]
    out: dict = {}
    for r in events.request_events(spark.createDataFrame(rows, REQUESTS)).orderBy("request_id", "seq").collect():
        out.setdefault(r.request_id, []).append((r.seq, r.event, r.data))
    assert [e[1] for e in out["a"]] == ["result", "progress"] * 3 + ["done"]
    assert json.loads(out["a"][1][2]) == {"done": 1, "total": 3, "percent": 33} and out["a"][-1][2] == '{"results":[1,2,3]}'
    assert out["b"] == out["c"] == [(0, "done", '{"results":[]}')]
    assert out["d"][-1] == (2, "error", "sentence 1: oops") and len(out["d"]) == 3


def test_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "request_id string, sentences array<string>"
    spark.createDataFrame([("a", ["x y", "z"]), ("b", [])], schema).write.parquet(source)

    def answer(batch):
        done = F.transform("sentences", lambda s: F.struct(F.concat(F.lit('"'), s, F.lit('"')).alias("result"), F.lit(None).cast("string").alias("error")))
        return batch.select("request_id", done.alias("results"))

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        events.start(stream, answer, sink, str(tmp_path / "ckpt")).awaitTermination(60)
        return spark.read.parquet(sink).count()

    assert run() == 6
    spark.createDataFrame([("c", ["q"])], schema).write.mode("append").parquet(source)
    assert run() == 9
    assert run() == 9  # nothing new


def test_events_in_order_over_micro_batches(spark, tmp_path):
    """Answers come out of order and twice, a batch at a time; events are those of the whole requests."""
    from phraseloom.streaming import ordered

    kind = "req string, sent_index int, total int, result string, error string"
    batches = [
        [("a", 1, 3, '{"n":1}', None), ("b", 0, 2, '{"n":0}', None), ("e", None, 0, None, None)],
        [("a", 0, 3, '{"n":0}', None), ("b", 1, 2, None, "odd"), ("a", 1, 3, '{"n":9}', None)],
        [("a", 2, 3, '{"n":2}', None), ("b", 0, 2, '{"n":0}', None)],
        [("a", 0, 3, '{"n":0}', None), ("e", None, 0, None, None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = ordered.ordered_events(spark.readStream.schema(kind).json(str(tmp_path / "in")), "req", keep_seconds=None)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        found = {}
        for r in spark.read.parquet(str(tmp_path / "out")).orderBy("req", "seq").collect():
            found.setdefault(r.req, []).append((r.seq, r.event, r.data))
        if i == 0:
            assert found == {"b": [(0, "result", '{"index":0,"result":{"n":0}}'), (1, "progress", '{"done":1,"total":2,"percent":50}')], "e": [(0, "done", '{"results":[]}')]}
    whole = [("a", [('{"n":0}', None), ('{"n":1}', None), ('{"n":2}', None)]), ("b", [('{"n":0}', None), (None, "odd")]), ("e", [])]
    expected = {}
    for r in events.request_events(spark.createDataFrame(whole, "req string, results array<struct<result:string,error:string>>"), "req").orderBy("req", "seq").collect():
        expected.setdefault(r.req, []).append((r.seq, r.event, r.data))
    assert found == expected


def test_checkpoint_folder_is_the_sessions(spark):
    from phraseloom.plans.lineage import cut_lineage

    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_states_are_kept_by_group(spark, tmp_path, monkeypatch):
    """Thousands of requests take a call of Python and a state for each group, not for each request; keys stay exact, null included."""
    from phraseloom.streaming import ordered

    monkeypatch.setattr(ordered, "GROUPS", 8, raising=False)
    n, large = 2000, (1 << 60) + 1
    rows = spark.range(n).select(F.when(F.col("id") > 0, F.col("id") + large).alias("req"), F.posexplode(F.array(F.lit("1"), F.lit("2"))).alias("sent_index", "result"))
    rows = rows.select("req", "sent_index", F.lit(2).alias("total"), "result", F.lit(None).cast("string").alias("error"))
    for part in (rows.where("sent_index = 1"), rows):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ordered.ordered_events(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "req", keep_seconds=None)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 5 * n and found.distinct().count() == 5 * n
    assert found.agg(F.max("req"), F.countDistinct("req"), F.count_if(F.col("req").isNull())).first() == (large + n - 1, n - 1, 5)


def test_requests_of_a_group_go_one_by_one():
    """A request's state goes a while after its own last answer, whatever else its group gets."""
    from types import SimpleNamespace

    import pandas as pd

    from phraseloom.streaming import ordered

    class State(SimpleNamespace):
        def update(self, new):
            self.get, self.exists = new, True

        def remove(self):
            self.exists = False

        def getCurrentProcessingTimeMs(self):
            return self.now

        def setTimeoutDuration(self, ms):
            self.wait = ms

    def frame(*rows):
        return iter([pd.DataFrame(rows, columns=["_name", "sent_index", "total", "result", "error"])])

    state = State(exists=False, hasTimedOut=False, now=1000)
    assert len(pd.concat(ordered._events(frame(("=a", 0, 1, "1", None), ("=b", 1, 2, "1", None)), state, 100))) == 3
    state.now = 1060
    assert len(pd.concat(ordered._events(frame(("=b", 1, 2, "1", None), ("=a", 0, 1, "1", None), ("=c", 0, 2, "1", None)), state, 100))) == 2
    state.now, state.hasTimedOut = 1150, True
    assert state.wait == 100 and not list(ordered._events(iter([]), state, 100)) and set(json.loads(state.get[0])) == {"=a", "=b", "=c"} and state.wait == 10
    state.now = 1160
    assert not list(ordered._events(iter([]), state, 100)) and not state.exists
