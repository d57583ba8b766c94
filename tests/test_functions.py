"""Functions and operators on inline rows."""

import json
import os
import random
import re
import shutil
import subprocess
import sys
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.functions import objects as ob
from reportlake.functions import text as tx
from reportlake.operators import clean, coverage, extract, ground, objects, runlog, similarity


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values), strict=True)))
    return df.select(expr.alias("r")).first().r


def test_slug_and_stem(spark):
    assert one(spark, tx.slug(F.col("x")), x="  APT 29 / Cozy-Bear! ") == "apt-29-cozy-bear"
    assert one(spark, tx.slug(F.col("x")), x=None) == ""
    assert one(spark, tx.clean_stem(F.col("x")), x="delta-report.MD") == "delta-report_md"
    assert one(spark, tx.clean_stem(F.col("x")), x="plain") == "plain"


def test_actor_validity(spark):
    for name, ok in (("Wizard Spider", True), ("FIN7", True), ("1234", False), ("captain of it", True), ("a b c d e f", False), ("Kroll’s Threat", False)):
        assert one(spark, tx.valid_actor(F.col("x")), x=name) is ok, name


def test_paths_keys_and_subnets(spark):
    text = r"ran C:\Temp\a.exe, then /etc/passwd. key HKLM\Software\Run; UseLogonCredential 10.1.2.3 8.8.8.8 192.168.4.0/24"
    assert "/etc/passwd" in one(spark, tx.file_paths(F.col("x")), x=text)
    assert one(spark, tx.registry_keys(F.col("x")), x=text) == [r"HKLM\Software\Run", "UseLogonCredential"]
    assert one(spark, tx.subnets(F.col("x")), x=text) == ["10.1.2.0/24", "192.168.4.0/24"]


def test_uuid5_is_rfc4122(spark):
    for name in ("bundle", "naïve", ""):
        assert one(spark, ob.uuid5(F.col("x")), x=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_valid_stix_id(spark):
    good = "tool--" + str(uuid.uuid4())
    assert one(spark, ob.valid_stix_id(F.lit("tool"), F.col("x")), x=good)
    assert not one(spark, ob.valid_stix_id(F.lit("malware"), F.col("x")), x=good)
    assert not one(spark, ob.valid_stix_id(F.lit("tool"), F.col("x")), x="tool--123")


def test_json_salvage(spark):
    for raw, want in (('```json\n{"a":1}\n```', '{"a":1}'), ('so {"a":{"b":1}} end', '{"a":{"b":1}}'), ('{"a":1', '{"a":1}'), ("nothing", None)):
        assert one(spark, ob.salvage_json(F.col("x")), x=raw) == want


def test_secrets_are_dropped(spark):
    for key, secret in (("api_key", True), ("max_tokens", False), ("token", True), ("key_env", False), ("api_key_env", False)):
        assert one(spark, tx.secret_key(F.col("x")), x=key) is secret, key


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(ob.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_entropy(spark):
    assert one(spark, clean.entropy(F.col("x")), x="aabb") == 1.0
    assert one(spark, clean.entropy(F.col("x")), x="") == 0.0


def test_html(spark):
    html = "<html><nav><p>no</p></nav><p>One <b>two</b></p><ul><li>x</li></ul><table><tr><td>a</td><td>b</td></tr></table></html>"
    assert one(spark, clean.html_text(F.col("x")), x=html) == "One two\n• x\n[Table]\na | b"
    assert one(spark, clean.html_text(F.col("x")), x=None) == ""


def test_pipe_tables_and_headers(spark):
    docs = spark.createDataFrame([(1, "> | Host | OS |\n> |---|---|\n> | a | linux |\n\ntext | no table\n| x | y |\n|---|---|\n| 1 | 2 |")], "doc_id long, text string")
    got = {(r.table_no, r.row_no): r.cells for r in extract.pipe_tables(docs).collect()}
    assert got[(1, 0)] == ["Host", "OS"] and got[(1, 1)] == ["a", "linux"] and got[(2, 1)] == ["1", "2"]


def test_hierarchy_never_matches_siblings(spark):
    wanted = spark.createDataFrame([(1, "T1", []), (1, "T2.001", []), (1, "T3.001", [])], "bundle_id long, technique_id string, attested array<string>")
    caps = spark.createDataFrame([(1, "T1.005", ["windows"]), (2, "T2", ["linux"]), (3, "T3.002", [])], "capability_id long, technique_id string, platforms array<string>")
    got = {r.technique_id: r.status for r in coverage.coverage_status(wanted, caps).collect()}
    assert got == {"T1": "covered", "T2.001": "covered", "T3.001": "unmatched"}


def test_platform_excluded_isnt_unmatched(spark):
    wanted = spark.createDataFrame([(1, "T1", ["macos"])], "bundle_id long, technique_id string, attested array<string>")
    caps = spark.createDataFrame([(1, "T1", ["windows"])], "capability_id long, technique_id string, platforms array<string>")
    assert coverage.coverage_status(wanted, caps).first().status == "platform_excluded"


def test_fusion(spark):
    rows = [(1, 0, "a", "k", "", ["x"]), (1, 1, "b", "k", "first", ["y", "x"]), (2, 0, "c", "k", "second", None), (2, 1, "d", "solo", None, [])]
    df = spark.createDataFrame(rows, "bundle_id int, pos int, id string, key string, name string, labels array<string>")
    got = {r.key: r for r in objects.fuse(df, ["name"], ["labels"]).collect()}
    assert (got["k"].id, got["k"].name, got["k"].labels, got["k"].fused_from) == ("a", "first", ["x", "y"], ["a", "b", "c"])
    assert got["solo"].fused_from is None and got["solo"].name is None


def test_score_guards(spark):
    got = spark.createDataFrame([(1, "a"), (1, "b")], "k int, item string")
    want = spark.createDataFrame([(1, "a"), (2, "z")], "k int, item string")
    r = {x.k: x for x in coverage.score_sets(got, want, ["k"], "item").collect()}
    assert (r[1].precision, r[1].recall, r[1].f1) == (0.5, 1.0, 0.666667)
    assert (r[2].precision, r[2].recall, r[2].f1) == (0.0, 0.0, 0.0)


def test_collapse_is_idempotent(spark):
    df = spark.createDataFrame([(1, "T1"), (1, "T1.001"), (2, "T1")], "doc_id int, technique_id string")
    once = ground.collapse_parents(df)
    assert sorted(map(tuple, once.collect())) == [(1, "T1.001"), (2, "T1")]
    assert sorted(map(tuple, ground.collapse_parents(once).collect())) == sorted(map(tuple, once.collect()))


def test_context_keeps_the_first_block(spark):
    df = spark.createDataFrame([(1, 0, "x" * 4000), (1, 1, "y" * 4), (2, 0, "z" * 8), (2, 1, "z" * 8)], "conv_id int, turn int, text string")
    got = {r.conv_id: (r.n_kept, r.omitted) for r in runlog.context_within(df, 3).collect()}
    assert got == {1: (1, 1), 2: (1, 1)}


def test_step_order(spark):
    df = spark.createDataFrame([(1, {"thought_10": "b", "thought_2": "a", "tool_name_2": "t"})], "run_id int, params map<string,string>")
    assert [(r.idx, r.thought) for r in runlog.steps(df).orderBy("idx").collect()] == [(2, "a"), (10, "b")]


def test_created_entities_inside_runs(spark):
    """One pass without a shuffle; names from objects, lists of objects, of JSON texts and of both, the last name of an id."""
    args = lambda *ids, **k: json.dumps({"atomic_ordering": ids, **k})
    said = {"observation_1": json.dumps([{"item": "a", "name": "A"}, {"item": 7, "name": "seven"}]), "observation_3": json.dumps({"item": "a", "name": "A2"}), "observation_4": json.dumps(['{"item": "b", "name": "B"}', {"item": "c", "name": "C"}, 5, None]),
            "observation_5": '[{"item": "d", "name": "D"}] x', "observation_6": '{"item": "e", "\\u006eame": "E"}', "observation_7": json.dumps({"item": "f", "name": ""}), "thought_1": "name item"}
    call = {"tool_name_10": "make", "tool_args_10": args("x"), "observation_10": "no", "tool_name_9": "make", "tool_args_9": args("c", "a", "z", "7", "b", "a", "d", "e", "f"), "observation_9": json.dumps({"made": "m1"})}
    rows = [(1, {**said, **call}), (2, {**said, "tool_name_2": "make", "tool_args_2": args("a", name="n"), "observation_2": "no"}), (3, {**said, "tool_name_2": "other", "tool_args_2": args("a")}), (4, {**said, "tool_name_2": "make", "tool_args_2": '{"name": "x"}'}),
            (5, {**said, "tool_name_2": "make", "tool_args_2": args("z")}), (6, {}), (7, {**said, "tool_name_2": "make", "tool_args_2": "[" + args("a") + "]"})]
    df = spark.createDataFrame(rows, "run_id int, params map<string,string>")
    made = runlog.created_entity(df, "make", "made", "item")
    assert "Exchange" not in made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
    got = {r.run_id: (r.name, r.entity_id, r.members, r.names) for r in made.collect()}
    assert got == {1: ("Unnamed", "m1", list("caz7badef"), ["C", "A2", "seven", "B", "A2", "E"]), 2: ("n", "unknown", ["a"], ["A2"])}


def test_greedy_and_min_id_dedupe(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.95, 0.31]), (1, 3, [0.8, 0.6]), (2, 4, [1.0, 0.0])], "g int, vec_id long, embedding array<float>")
    assert sorted(r.vec_id for r in similarity.greedy_kept(df, "g", 0.92).collect()) == [1, 3, 4]
    assert sorted(r.vec_id for r in similarity.first_kept(df, "g", 0.92).collect()) == [1, 4]


def test_joins_avoid_nested_loops(spark):
    wanted = spark.createDataFrame([(1, "T1", [])], "bundle_id long, technique_id string, attested array<string>")
    caps = spark.createDataFrame([(1, "T1", [])], "capability_id long, technique_id string, platforms array<string>")
    plan = coverage.coverage_status(wanted, caps)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_valid_json_is_one_value(spark):
    for raw, ok in (('{"a":1}', True), (' [1, 2] ', True), ('"x"', True), ("7", True), ('{"a":1} x', False), ('{"a":1},{"b":2}', False), ('1,"b":2', False), ("", False), (None, False), ("{bad", False), ('{"a":{"b":{"c":1}}} trailing', False)):
        assert one(spark, ob.valid_json(F.col("x")), x=raw) is ok, raw
    assert one(spark, ob.salvage_json(F.col("x")), x='{"a":{"b":{"c":1}}} trailing') == '{"b":{"c":1}}'


def plain_tables(text):
    """(table, row, cells) by one pass over the lines."""
    lines = [re.sub(r"^\s*>\s?", "", x) for x in re.split(r"\r\n|\n", text)]
    is_sep, found, header, skip = (lambda s: re.fullmatch(r"\s*\|?\s*[:\-\s|]+\s*\|?\s*", s)), [], None, False
    for i, s in enumerate(lines):
        wide = s.count("|") >= 2
        if skip:
            skip = False
        elif header is None or not wide:
            header = None
            if wide and i + 1 < len(lines) and is_sep(lines[i + 1]):
                header, skip = (0 if not found else found[-1][0]) + 1, True
                found.append((header, 0, cells(s)))
        elif not is_sep(s):
            found.append((header, found[-1][1] + 1, cells(s)))
    return found


def cells(s):
    parts = [c.strip() for c in s.split("|")]
    parts = parts[1:] if parts and not parts[0] else parts
    return parts[:-1] if parts and not parts[-1] else parts


def test_pipe_tables_against_one_pass(spark):
    rng = random.Random(2)
    kinds = ["a | b | c", "| x | y |", "|---|---|", "---", "one | pipe", "", "text", "> | q | r |", ":-: | --- | -"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    got = {}
    for r in extract.pipe_tables(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.table_no, r.row_no, r.cells))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_tables(text), text


def merged(values):
    """What the values of one place give, in order; a marker if there are none."""
    full = [v for v in values if v not in (None, "", [], {}) or (v == 0 and not isinstance(v, (str, list, dict)) and v is not None)]
    if not full:
        return values[-1]
    kind = type(full[0])
    if kind is dict:
        parts = [v for v in full if type(v) is dict]
        return {k: merged([p[k] for p in parts if k in p]) for p in parts for k in p}
    if kind is list:
        rest = [x for v in full[1:] if type(v) is list for x in v]
        out = list(full[0])
        for x in rest:
            if json.dumps(x, sort_keys=True) not in {json.dumps(y, sort_keys=True) for y in out}:
                out.append(x)
        return out
    return full[0]


def test_fusion_in_depth_against_plain_python(spark):
    rng = random.Random(6)

    def value(depth):
        k = rng.randrange(9 if depth else 6)
        return [None, "", "a", "é\"q", rng.randrange(3), [rng.choice(["x", "y", 1, {"k": [1]}, [2]]) for _ in range(rng.randrange(4))]][k] if k < 6 else {rng.choice("abc"): value(depth - 1) for _ in range(rng.randrange(3))}

    rows = []
    for i in range(120):
        obj = {"id": f"i{i % 7}", **{k: value(3) for k in "abcd" if rng.random() < 0.8}}
        rows.append((f"k{i % 9}" if i < 110 else f"solo{i}", i // 10, i % 10, json.dumps(obj)))
    rows += [("k0", 99, 0, "no json"), ("k0", 99, 1, None), ("k1", 99, 2, "[1]")]
    df = spark.createDataFrame(rows, "key string, bundle_id int, pos int, obj string").repartition(3)
    got = {r.key: r for r in objects.fuse_documents(df).collect()}
    groups = {}
    for key, _, _, raw in rows[:120]:
        groups.setdefault(key, []).append(json.loads(raw))
    assert set(got) == set(groups)
    for key, objs in groups.items():
        want = merged([{k: v for k, v in o.items() if k != "id"} for o in objs]) if any(len(o) > 1 for o in objs) else {}
        assert json.loads(got[key].obj) == want, key
        assert got[key].id == objs[0]["id"] and got[key].n_objects == len(objs)
        assert got[key].fused_from == (list(dict.fromkeys(o["id"] for o in objs)) if len(objs) > 1 else None)
    assert objects.fuse_documents(df.limit(0)).count() == 0


def test_greedy_rule_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 5)
    rng = np.random.default_rng(4)
    rows = [(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 90), rng.normal(0, 1, (90, 3)), strict=True))]
    rows += [(None, 200, [1.0, 0.0, 0.0]), (None, 201, [1.0, 0.0, 0.1]), (0, 202, None), (0, 203, []), (0, 204, [0.0, 0.0, 0.0]), (0, 205, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, vec_id long, embedding array<float>")
    kept, first = [], []
    for at, (g, i, v) in enumerate(rows):
        x = np.asarray(v or [0.0], np.float32).astype(float)
        near = lambda j, x=x, g=g: rows[j][0] == g and rows[j][2] and len(rows[j][2]) == len(x) and np.linalg.norm(x) > 0 and np.linalg.norm(rows[j][2]) > 0 and x @ np.asarray(rows[j][2], np.float32) / np.linalg.norm(x) / np.linalg.norm(rows[j][2]) >= 0.8
        earlier = range(at)
        if not any(near(j) for j in earlier):
            first.append(i)
        if not any(near(j) for j in earlier if rows[j][1] in kept):
            kept.append(i)
    assert sorted(r.vec_id for r in similarity.greedy_kept(df, "g", 0.8).collect()) == sorted(kept)
    assert sorted(r.vec_id for r in similarity.first_kept(df, "g", 0.8).collect()) == sorted(first)


def test_hosts_of_lists(spark):
    text = "Target hosts for the check:\n* alphamon\n- the\n- srv01\n- word\n$hosts=@(\"bakemon\"\n" + "x" * 300 + "\n* farmon\nsee `Gamma1` (10.0.0.1) and tcp (10.0.0.2)"
    got = {r.host: r.ip for r in extract.hosts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {"alphamon": "", "srv01": "", "bakemon": "", "gamma1": "10.0.0.1"}


def test_first_terminal_stage_stays(spark):
    rows = [(1, "run", 1), (1, "done", 2), (1, "late", 3), (1, "failed", 4), (2, "run", 5), (2, "next", 6)]
    df = spark.createDataFrame(rows, "k int, stage string, ts int").withColumn("tie", F.lit(0))
    assert {r.k: r.stage for r in runlog.latest_stage(df, "k", "stage", "ts", ("done", "failed"), "tie").collect()} == {1: "done", 2: "next"}


def test_route_gates(spark):
    noise = "".join(chr(33 + (i * 37) % 90) for i in range(400))
    prose = "The group has used tools. It is known. " + noise
    rows = [("a-report.txt", prose + " they are of the same kind and it is a report of the day " * 5), ("a-report.txt", noise), ("12.txt", "plain words"), ("ab.txt", "plain"), ("x.pdf", None), ("x.pdf", " "), ("pic.svg", "x"), ("pic.png", None)]
    df = spark.createDataFrame(rows, "name string, text string")
    got = [(r.status, r.skip_reason) for r in clean.route(df).collect()]
    assert got == [("[TEXT]", None), ("[SKIP]", "code"), ("[SKIP]", "filename"), ("[SKIP]", "filename"), ("[ERR]", None), ("[SKIP]", "empty"), ("[SKIP]", "extension"), ("[IMG]", None)]


def test_enrichers_declare_what_they_add(spark):
    prompts = spark.createDataFrame([(1, ["b"])], "prompt_id int, bundle_ids array<string>")
    lazy = runlog.Enricher("lazy", ("x",), lambda df, settings: df)
    with pytest.raises(ValueError, match="does not add"):
        runlog.enriched(prompts, [lazy], {"lazy": {}})
    with pytest.raises(ValueError, match="unknown"):
        runlog.enriched(prompts, [lazy], {"other": {}})
    blocks = spark.createDataFrame([], "bundle_id string, pos int, block string")
    with pytest.raises(Exception, match="nothing to ground on"):
        runlog.enriched(prompts, [runlog.intel_enricher(blocks, 9)], {"intel": {}}).collect()


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace as N

    from reportlake.sources.storage import shared_folder

    unset = N(conf=N(get=lambda *_: None), sparkContext=N(getCheckpointDir=lambda: None, master="spark://x:1"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(unset)


def test_entry_imports_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env={"PATH": os.environ["PATH"], "PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 90 and out[1:3] == ["False", "False"] and int(out[3]) > 90
