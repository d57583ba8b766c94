"""SQL functions against the column functions of the same name."""

import datetime

from pyspark.sql import functions as F

from reportlake.functions import objects as ob
from reportlake.functions import sql
from reportlake.functions import text as tx
from reportlake.operators import ground

TEXTS = [
    None, "", "  Amber Group's Team \n", "report.final.MD", ".hidden", r"ran C:\Temp\a.exe, then /etc/passwd. key HKLM\Software\Run; UseLogonCredential 10.1.2.3 8.8.8.8 172.20.1.9 192.168.4.0/24",
    "files renamed to `.lock3` and appended with .zip", "T1059 and T1059.001, T1059 then CVE-2021-12345 but sk-abcdefgh123 [[ ## done ## ]]  ", "d41d8cd98f00b204e9800998ecf8427e da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "They weaken organizational security posture. Why? Yes!", '{"b": 1, "a": [2, 1]}', '{"a": 1} x', "tool--3d5b5a0c-7b3f-4f2e-9a55-0123456789ab", "naïve é", "a b c d e f", "api_key", "max_tokens", "key_env",
]


def test_sql_functions_equal_column_functions(spark):
    sql.register(spark)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    x = F.col("x")
    same = {
        "rl_strip(x)": tx.strip(x), "rl_slug(x)": tx.slug(x), "rl_squash(x)": tx.squash(x), "rl_spaced(x)": tx.spaced(x), "rl_tokens(x)": tx.tokens(x), "rl_sorted_set(split(x, ' '))": tx.sorted_set(F.split(x, " ")),
        "rl_matches(x, '[a-z]+')": tx.matches(x, "[a-z]+"), "rl_extension(x)": tx.extension(x), "rl_clean_stem(x)": tx.clean_stem(x), "rl_technique_ids(x)": tx.sorted_set(tx.matches(x, tx.TECHNIQUE_ID)),
        "rl_md5s(x)": tx.matches(x, tx.HASHES["MD5"]), "rl_sha1s(x)": tx.matches(x, tx.HASHES["SHA1"]), "rl_sha256s(x)": tx.matches(x, tx.HASHES["SHA256"]), "rl_ipv4s(x)": tx.matches(x, tx.IPV4, 1), "rl_subnets(x)": tx.subnets(x),
        "rl_file_paths(x)": tx.file_paths(x), "rl_registry_keys(x)": tx.registry_keys(x), "rl_marker_extensions(x)": tx.marker_extensions(x), "rl_cve_key('', x, 'cve-2020-1111')": tx.cve_key(F.lit(""), x, F.lit("cve-2020-1111")),
        "rl_normal_actor(x)": tx.normal_actor(x), "rl_valid_actor(x)": tx.valid_actor(x), "rl_split_clauses(x)": tx.split_clauses(x), "rl_canonical_phrase(x)": tx.canonical_phrase(x), "rl_sentences(x)": tx.sentences(x),
        "rl_evidence_window(x, 3, 4)": tx.evidence_window(x, F.lit(3), F.lit(4)), "rl_scrub(x)": tx.scrub(x), "rl_strip_markers(x)": tx.strip_markers(x), "rl_truncate(x, 9)": tx.truncate(x, 9), "rl_secret_key(x)": tx.secret_key(x),
        "rl_transient(x, 503)": tx.transient(x, F.lit(503)), "rl_kilobytes(length(x))": tx.kilobytes(F.length(x)), "rl_estimate_tokens(x)": tx.estimate_tokens(x), "rl_preview(split(x, ' '), 2)": tx.preview(F.split(x, " "), 2),
        "rl_uuid5(x)": ob.uuid5(x), "rl_stix_id('tool', x)": ob.stix_id("tool", x), "rl_valid_stix_id('tool', x)": ob.valid_stix_id(F.lit("tool"), x), "rl_valid_json(x)": ob.valid_json(x), "rl_canonical_json(x)": ob.canonical_json(x),
        "rl_platform_ok(split(x, ' '), array('a'))": ground.platform_ok(F.split(x, " "), F.array(F.lit("a"))), "rl_similarity_term(length(x) / 50D)": ground.similarity_term(F.length(x) / 50.0),
    }
    got = df.select("i", *[F.expr(e).alias(f"s{k}") for k, e in enumerate(same)], *[c.alias(f"c{k}") for k, c in enumerate(same.values())]).collect()
    for r in got:
        for k, e in enumerate(same):
            assert r[f"s{k}"] == r[f"c{k}"], (e, TEXTS[r.i])
    one = spark.sql("SELECT rl_cosine(array(1F, 0F), array(1F, 0F)) AS a, rl_cosine(array(0F), array(1F)) AS b, rl_f1(1, 1, 0) AS f, rl_without_secrets(map('api_key', 'x', 'n', 'y')) AS m, rl_iso_utc(timestamp'2024-01-02 03:04:05') AS t").first()
    assert (one.a, one.b, round(one.f, 6), one.m, one.t) == (1.0, 0.0, 0.666667, {"n": "y"}, "2024-01-02T03:04:05.000000Z")
    assert datetime.datetime.fromisoformat(one.t.replace("Z", "+00:00")).year == 2024
    assert len(sql.SQL_FUNCTIONS) > 40
