"""Matching of patterns, names, vectors and nested values against plain Python."""

import json
import random
import re

import numpy as np
import pytest

from reportlake.functions import text as tx
from reportlake.operators import extract, ground, jsontree, markup, objects, similarity
from reportlake.sources import reports


@pytest.mark.parametrize(("pattern", "literal"), [
    (r"(?i)power\s*shell", "power"), (r"\bLSASS\.exe\b", "lsass.exe"), ("a|bcd", ""), ("(abc)def", "def"), ("colou?rful", "colo"), ("ab{2}cde", "cde"), (r"\Qa.b\E\s", "a.b"),
    (r"[abc\]]defg+hij", "defg"), ("(?x) a b c", ""), ("^kept$", "kept"), ("(x|y)", ""), (r"\x41bcd", "bcd"), (r"ab\d+cd", "ab"), ("é+abc", "abc"), ("", "")])
def test_required_literal(pattern, literal):
    assert ground.required_literal(pattern) == literal


def test_many_anchors_against_plain_regex(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(1500)]
    anchors = [(i, rf"(?i)\b{w}\b" if i % 3 else rf"{w}(?:x|s)?\s", f"f{i}", 0.5) for i, w in enumerate(words)] + [(2000, r"\d\d:\d\d", "time", 0.4), (2001, "(?i)q|Z", "either", 0.3)]
    docs = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(12)) + (" 12:30" if i % 4 == 0 else "")) for i in range(40)] + [(100, None), (101, ""), (102, "Z")]
    got = ground.anchor_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(anchors, "anchor_id long, pattern string, fragment string, confidence double"))
    want = {(d, a) for d, t in docs for a, p, *_ in anchors if t is not None and re.search(p, t)}
    assert {(r.doc_id, r.anchor_id) for r in got.collect()} == want
    none = spark.createDataFrame([], "anchor_id long, pattern string, fragment string, confidence double")
    assert ground.anchor_hits(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_attested_platforms(spark):
    names = [["Windows"], ["Office 365", "macOS"], [".NET"], ["C++"], []]
    tech = spark.createDataFrame([(n,) for n in names], "platforms array<string>")
    docs = [(1, "windows and OFFICE 365 here"), (1, "macOS too"), (2, "windowsx office365"), (3, None), (4, "a.net b"), (5, "(windows)")]
    got = {r.doc_id: r.attested for r in ground.attested_platforms(spark.createDataFrame(docs, "doc_id int, text string"), tech).collect()}
    assert got == {1: ["macos", "office 365", "windows"], 2: [], 3: [], 4: [".net"], 5: ["windows"]}


def test_products_of_vectors(spark):
    rows = [(1, [1.0, 2.0], [3.0, 4.0]), (2, None, [1.0]), (3, [1.0], None), (4, [1.0], [1.0, 2.0]), (5, [], []), (6, [0.5], [4.0]), (7, None, None)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>").coalesce(1)
    out = ground.with_products(df, "a", "b", "sim")
    assert {r.id: r.sim for r in out.collect()} == {1: 11.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 2.0, 7: 0.0} and out.columns == ["id", "sim"]
    assert ground.with_products(df.filter("id IN (2, 7)"), "a", "b", "sim").count() == 2


def test_inference_keeps_what_scores_decide(spark):
    """Bounds drop no pair that all scores would keep."""
    rng = np.random.default_rng(5)
    words = [f"w{i}x" for i in range(12)]
    tech = [(f"T{i}", [words[i % 12], words[(i * 5) % 12]], [["windows"], [], ["linux", "macos"]][i % 3], [["impact"], []][i % 2], rng.normal(0, 1, 4).tolist() if i % 5 else None) for i in range(40)]
    behaviours, docs = [], {}
    for d in range(6):
        for s in range(8):
            text = "run " + " ".join(rng.choice(words, 4)) + (" windows" if d % 2 else "")
            behaviours.append((d, s, text, "Impact" if d == 1 else ("recon" if d == 2 else None), tech[(d * s) % 40][4] if s % 3 else rng.normal(0, 1, 4).tolist()))
            docs[d] = docs.get(d, "") + " " + text
    schema = "technique_id string, tokens array<string>, platforms array<string>, phases array<string>, vector array<float>"
    got = ground.infer(
        spark.createDataFrame(behaviours, "doc_id int, seq int, text string, phase string, vector array<float>"), spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame(tech, schema), ["run"], ["the"]).collect()

    def cosine(a, b):
        if a is None or b is None:
            return 0.0
        a, b = (np.asarray(x, np.float32).astype(float) for x in (a, b))
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    want = []
    for d in docs:
        rows = []
        for _, s, text, _, v in (b for b in behaviours if b[0] == d):
            toks = re.findall("[a-z0-9]+", text.lower())
            found = []
            for tid, names, platforms, phases, tv in tech:
                if not set(names) & set(toks) or (len(platforms) == 1 and platforms[0] not in docs[d]):
                    continue
                sim = cosine(v, tv)
                band = 1.0 if sim >= 0.65 else 0.7 if sim >= 0.45 else 0.4 if sim >= 0.3 else 0.1
                off = d in (1, 2) and phases and not any({1: "impact", 2: "recon"}[d] in p for p in phases)
                found.append((-round((8.5 + sim * 3 * band) * (0.5 if off else 1.0), 6), tid, s))
            rows += sorted(x for x in found if x[0] <= -3)[:2]
        want += [(d, s, t, -x) for x, s, t in sorted((x, s, t) for x, t, s in rows)[:15]]
    assert sorted((r.doc_id, r.seq, r.technique_id, round(r.score, 4)) for r in got) == sorted((d, s, t, round(x, 4)) for d, s, t, x in want)


def test_names_of_any_length(spark):
    names = [("six words are quite a name", 1), ("six words", 2), ("words are", 3), ("is", 4), ("one", 5), ("six words are quite another name", 6), (" ".join(f"n{i}" for i in range(40)), 7), ("one", 8)]
    docs = [(1, "Six words are quite a name, six WORDS are; one-one!"), (2, "six words are quite"), (3, None), (4, ""), (5, "x " + " ".join(f"n{i}" for i in range(40)) + " y one")]
    got = extract.gazetteer(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(names, "name_key string, entity_id int"))
    want = {}
    for d, t in docs:
        toks = re.findall("[a-z0-9]+", (t or "").lower())
        for n, e in names:
            k = n.split()
            hits = sum(toks[i : i + len(k)] == k for i in range(len(toks)))
            if hits and len(n) >= 3:
                want[d, e] = hits
    assert {(r.doc_id, r.entity_id): r.n for r in got.collect()} == want
    assert extract.gazetteer(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([], "name_key string, entity_id int")).count() == 0


def test_held_by_joins_on_the_rarest_part(spark):
    rng = random.Random(1)
    outer = [(i, "common " + "".join(rng.choice("abcd") for _ in range(8))) for i in range(60)] + [(99, None), (98, "")]
    inner = [(i, t) for i, t in enumerate(["common", "abc", "ab", "a", "common a", "zzz", "", None, "mon dcb", "c"])]
    got = ground.held_by(spark.createDataFrame(inner, "i int, a string"), spark.createDataFrame(outer, "o int, b string"), "a", "b")
    assert sorted((r.i, r.o) for r in got.collect()) == sorted((i, o) for i, a in inner for o, b in outer if a and b and a in b)


@pytest.mark.parametrize("threshold", [0.97, 0.8])
def test_pivots_lose_no_near_vector(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "CELL", 8)
    monkeypatch.setattr(similarity, "BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 6))
    rows = [(i % 2, i, (centres[i % 12] + rng.normal(0, 0.15, 6)).tolist()) for i in range(150)]
    rows += [(0, 300 + i, rows[0][2]) for i in range(5)] + [(1, 400, [0.0] * 6), (1, 401, [0.0] * 6), (1, 402, None)]
    df = spark.createDataFrame(rows, "g int, vec_id long, embedding array<float>")
    unit = {i: np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32)) for _, i, v in rows if v and any(v)}
    near = lambda i, j: i in unit and j in unit and unit[i] @ unit[j] >= threshold
    group = {i: g for g, i, _ in rows}
    order = sorted(group)
    first = [i for i in order if not any(j < i and group[j] == group[i] and near(i, j) for j in order)]
    kept = []
    for i in order:
        if not any(group[j] == group[i] and near(i, j) for j in kept):
            kept.append(i)
    assert sorted(r.vec_id for r in similarity.first_kept(df, "g", threshold).collect()) == first
    assert sorted(r.vec_id for r in similarity.greedy_kept(df, "g", threshold).collect()) == kept
    v = similarity._prepared(df, "g")
    cells = similarity._cells(v, similarity._pivots(v), np.arccos(threshold), True).count()
    pivots = similarity._pivots(v).selectExpr("n_g", "size(pivots) / 6 AS n").collect()
    assert all(r.n > 1 for r in pivots) and (threshold < 0.9 or cells < sum(r.n for r in pivots) * 60)


def stripped(value):
    secret = lambda k: re.search(tx.SECRET_KEY, k) and not k.lower().endswith("_env")
    if isinstance(value, dict):
        return {k: stripped(v) for k, v in value.items() if not secret(k)}
    return [stripped(v) for v in value] if isinstance(value, list) else value


def test_secrets_of_any_depth(spark):
    rng = random.Random(6)
    names = ["a", "b", "api_key", "my_env", "password_env", "Secret", "max_tokens", "token", 'q"x', "sub"]

    def make(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice([1, 2.5, None, True, "x", 'say "password": 1', "token", ""])
        if kind < 0.5:
            return [make(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(names): make(depth - 1) for _ in range(rng.randrange(4))}

    docs = [(i, {"x": make(9), rng.choice(names): make(6)}) for i in range(40)]
    deep = "v"
    for i in range(14):
        deep = {"api_key": i, "in": deep} if i % 2 else [deep, {"token": 1}]
    docs.append((90, deep))
    rows = [(i, json.dumps(d)) for i, d in docs] + [(91, None), (92, "{broken"), (93, "3"), (94, "[]"), (95, '{"t\\u006fken": 1, "b": 2}')]
    got = {r.k: r.doc for r in jsontree.without_secrets(spark.createDataFrame(rows, "k int, doc string"), "k", "doc").collect()}
    assert {i: json.loads(got[i]) for i, _ in docs} == {i: stripped(d) for i, d in docs}
    assert [got[i] for i in (91, 92, 93, 94, 95)] == [None, None, "3", "[]", '{"b":2}']


def test_secrets_leave_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, '{"a":[{"token":{"b":[1]},"c":"x, \\"}"}],"zz_secret":1}'), (2, '{"token":1,"Secret":[{}]}'), (3, '[1.50,"password"]')], "k int, doc string")
    out = jsontree.without_secrets(df, "k", "doc")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.doc for r in out.collect()} == {1: '{"a":[{"c":"x, \\"}"}]}', 2: "{}", 3: '[1.5,"password"]'}


def test_forms_of_verbs(spark):
    words = "reported reports reporting identifies identified publishes stating noted Describes analyzing assessed be ran planned planning moved observation statement reporter note".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    told = {r.w for r in df.filter(tx.form_of(df.w, tx.REPORTER_VERBS)).collect()}
    assert told == set("reported reports reporting identifies identified publishes stating noted Describes analyzing assessed note".split())
    assert {r.w for r in df.filter(tx.form_of(df.w, ("run", "plan", "move"))).collect()} == {"ran", "planned", "planning", "moved"}


def test_tables_of_rows_with_one_key(spark):
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    docs = spark.createDataFrame([(1, table), (1, table), (1, "x\n" + table.replace("1", "3")), (2, "no table"), (3, None)], "doc_id int, text string")
    rows = sorted((r.doc_id, r.table_no, r.row_no, r.cells) for r in extract.pipe_tables(docs).collect())
    assert rows == [(1, 1, 0, ["a", "b"]), (1, 1, 0, ["a", "b"]), (1, 1, 1, ["1", "2"]), (1, 1, 1, ["3", "2"])]


def test_nested_markup(spark):
    pages = {
        1: "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</ul>", 2: "<table><tr><td>x<table><tr><td>y</table></table>", 3: None, 4: "plain", 5: "<p>one<p>two</p><script>var t='</p>'</script>",
        6: "<aside><p>no</p><aside>no</aside><p>no</p></aside><p>yes &lt;b&gt;</p>", 7: "<table><tr><th>h<td>1</table><ol><li> z </ol>", 8: "<p>a < b</p><br/><p></p>"}
    df = spark.createDataFrame([(k, h, "kept") for k, h in pages.items()], "k int, html string, text string")
    got = {r.k: r.text for r in markup.html_texts(df).collect()}
    assert got == {1: "• abc\n• b\n• c\n• d", 2: "[Table]\nxy | y\ny\n[Table]\ny", 3: "", 4: "", 5: "one\ntwo", 6: "yes <b>", 7: "• z\n[Table]\nh | 1", 8: "a < b"}


def test_relationships_keep_what_they_say(spark):
    bundle = lambda *o: [json.dumps(x) for x in o]
    tool = lambda i, n, **k: {"type": "tool", "id": f"tool--{i}", "name": n, **k}
    rel = lambda i, a, b, **k: {"type": "relationship", "id": f"relationship--{i}", "source_ref": f"tool--{a}", "target_ref": f"tool--{b}", **k}
    files = {("x", 1): bundle(tool(1, "A", labels=["p"]), tool(2, "B"), rel(1, 1, 2, relationship_type="uses", description="")),
             ("x", 2): bundle(tool(3, "a", labels=["q"]), rel(2, 3, 2, relationship_type="uses", description="said", labels=["l"], more={"deep": [1]}), rel(3, 3, 9)),
             ("y", 3): bundle(tool(3, "C"), tool(4, "D"), rel(4, 3, 4), rel(5, 3, 4, confidence=0))}
    rows = [(case, b, i, o) for (case, b), objs in files.items() for i, o in enumerate(objs)]
    get = lambda n: f"get_json_object(obj, '$.{n}') AS {n}"
    df = spark.createDataFrame(rows, "case string, bundle_id int, pos int, obj string").selectExpr(
        "case", "bundle_id", "pos", "obj", *[get(n) for n in ("type", "id", "name", "description", "source_ref", "target_ref", "relationship_type")], "CAST(NULL AS array<struct<source_name:string,external_id:string>>) AS refs")
    fused, edges = objects.fuse_bundles(df, "s", "case")
    assert sorted((r.case, r.id, r.n_objects) for r in fused.collect()) == [("x", "tool--1", 2), ("x", "tool--2", 1), ("y", "tool--3", 1), ("y", "tool--4", 1)]
    got = {r.id: (r.case, r.src, r.rel_type, r.dst, r.n, json.loads(r.obj)) for r in edges.collect()}
    assert set(got) == {"relationship--1", "relationship--4"}
    assert got["relationship--1"][:5] == ("x", "tool--1", "uses", "tool--2", 2)
    assert got["relationship--1"][5] == {"type": "relationship", "source_ref": "tool--1", "target_ref": "tool--2", "relationship_type": "uses", "description": "said", "labels": ["l"], "more": {"deep": [1]}}
    assert got["relationship--4"][:5] == ("y", "tool--3", "related-to", "tool--4", 2) and got["relationship--4"][5]["confidence"] == 0
    docs = {r.case: json.loads(r.document) for r in objects.fused_documents(fused, edges, df.select("case", "bundle_id"), "case").collect()}
    assert [o["id"] for o in docs["x"]["objects"]] == ["tool--1", "tool--2", "relationship--1"]
    assert docs["x"]["objects"][0] == {"id": "tool--1", "labels": ["p", "q"], "name": "A", "type": "tool", "x_fused_from": ["tool--1", "tool--3"]}
    assert docs["x"]["x_fusion"] == {"source_bundle_count": 2, "object_count": 3} and docs["y"]["x_fusion"] == {"source_bundle_count": 1, "object_count": 3}


def test_plan_folders(spark):
    files = {
        "l/p1/Emulation_Plan/README.md": 9, "l/p1/README.md": 99, "l/p1/Emulation_Plan/D1/X_Scenario.md": 5, "l/p1/Emulation_Plan/yaml/big_scenario.md": 50, "l/p1/Emulation_Plan/Phase1.md": 7, "l/p1/Emulation_Plan/a/b/phase2.md": 70,
        "l/p2/Operations_Flow/x.png": 1, "l/p2/README.md": 1, "l/p2/Infrastructure.md": 3, "l/p3/README.md": 1, "l/.p4/Emulation_Plan/README.md": 1, "l/p5/Emulation_Plan/Scenario.md": 3, "l/p5/Scenario.md": 1, "top.md": 1}
    got = reports.plan_files(spark.createDataFrame(list(files.items()), "path string, size long")).collect()
    assert sorted((r.plan, r.part, r.path, r.tier, r.n) for r in got) == [
        ("l/p1", "scenario", "l/p1/Emulation_Plan/Phase1.md", 1, 2), ("l/p2", "infrastructure", "l/p2/Infrastructure.md", 0, 1), ("l/p2", "scenario", "l/p2/README.md", 3, 1), ("l/p5", "scenario", "l/p5/Scenario.md", 0, 1)]


def test_versions_after_words_of_any_script(spark):
    from oracle import rows

    texts = ["Précieux 3.7 and préfeux 3.76.85.226, éabc 1.2", "Ab 1.2 Foo 1.2.3é Bar 2.0 x-Qux\x0bv3.1", "Foo 1.2-Bar 3.4.Baz 5.6", "Náme 1.0 naïve_ü 2.1.3.4.5 日本Abc 1.1 Abc日本 1.1", "a" * 31 + " 1.0 " + "b" * 32 + " 1.0", None, ""]
    got = {(r.doc_id, r.name, r.version) for r in extract.name_versions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    word = r"(?<![^\W])([A-Za-z][\w-]{2,30})\s+v?([0-9]+\.[0-9]+(?:\.[0-9]+(?:\.[0-9]+)?)?)\b"
    assert got == {(i, *m) for i, t in enumerate(texts) if t for m in re.findall(word, t)}

    import duckdb
    import pandas as pd

    from reportlake.plans.queries_extract import _NAMED_VERSIONS

    intel = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    assert rows(duckdb.sql(f"SELECT doc_id, n, v FROM ({_NAMED_VERSIONS}) x").df()) == rows(pd.DataFrame(sorted(got), columns=["doc_id", "n", "v"]))


def test_bundles_are_taken_apart_once(spark):
    text = '{"type": "bundle", "id": "bundle--zz", "objects": [5, {"type": "tool"}, {"type": "relationship", "id": "r", "source_ref": "x"}]}'
    out = objects.validate_bundles(spark.createDataFrame([(1, text), (2, "no")], "bundle_id int, value string"))
    # the rules read the objects' fields again, not the documents
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.bundle_id: r.errors for r in out.collect()}
    assert got[2] == ["Bundle is not a JSON object."] and len(got[1]) == 7
