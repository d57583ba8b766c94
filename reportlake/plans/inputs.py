"""Domain tables derived from the test tables by SQL that Spark and DuckDB both read.

Each is a SELECT over the test tables or over inputs above it; ``with_sql`` writes them as a WITH clause for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split()

INPUTS = {
    # every document as a file; ids, hosts, paths and names are written into its text
    "reports": """SELECT doc_id, source, lang, CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 0 THEN '-report.MD' WHEN 1 THEN '-note.txt' WHEN 2 THEN '-page.html' WHEN 3 THEN '-scan.png' WHEN 4 THEN '.txt' WHEN 5 THEN '-raw.bin' ELSE '-paper.pdf' END AS name,
        CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS text FROM documents""",
    "intel": """SELECT doc_id, source, text || chr(10) || 'Actor ' || CASE doc_id % 4 WHEN 0 THEN 'Amber Group' WHEN 1 THEN 'blue team' WHEN 2 THEN 'Carbon' ELSE 'nobody' END || ' ran t' || CAST(1000 + doc_id % 40 AS STRING)
        || CASE WHEN doc_id % 3 = 0 THEN '.00' || CAST(1 + doc_id % 3 AS STRING) ELSE '' END || ' and T' || CAST(1000 + doc_id % 17 AS STRING) || ' from srv' || CAST(doc_id % 9 AS STRING) || ' (10.' || CAST(doc_id % 7 AS STRING) || '.20.' || CAST(doc_id % 200 AS STRING)
        || ') in 192.168.' || CAST(doc_id % 5 AS STRING) || '.0/24 on windows with C:' || chr(92) || 'Temp' || chr(92) || 'tool' || CAST(doc_id % 6 AS STRING) || '.exe, key HKLM' || chr(92) || 'Software' || chr(92) || 'Run' || CAST(doc_id % 3 AS STRING) || '; use Rclone v1.' || CAST(doc_id % 5 AS STRING)
        || '.0 as ACME' || chr(92) || 'user' || CAST(doc_id % 8 AS STRING) || ', files renamed to `.lock' || CAST(doc_id % 4 AS STRING) || '` see CVE-2021-' || CAST(10000 + doc_id % 50 AS STRING) || ' token sk-abcdefgh' || CAST(doc_id AS STRING) || ' [[ ## done ## ]]' AS text FROM documents""",
    "technique": """SELECT technique_id, MIN(p_partkey) AS pos, MIN(p_name) AS name, MAX(CASE p_size % 4 WHEN 0 THEN 'windows' WHEN 1 THEN 'windows,linux' WHEN 2 THEN 'macos' ELSE '' END) AS platform_list,
        MAX(CASE p_size % 5 WHEN 0 THEN 'execution' WHEN 1 THEN 'impact' WHEN 2 THEN 'discovery,impact' WHEN 3 THEN 'collection' ELSE '' END) AS phase_list, MIN(p_partkey % 11) = 0 AS revoked
        FROM (SELECT *, 'T' || CAST(1000 + p_partkey % 45 AS STRING) || CASE WHEN p_partkey % 4 <> 0 THEN '.00' || CAST(p_partkey % 4 AS STRING) ELSE '' END AS technique_id FROM part) p GROUP BY technique_id""",
    "capability": """SELECT ps AS capability_id, 'T' || CAST(1000 + ps % 50 AS STRING) || CASE WHEN ps % 3 = 0 THEN '.00' || CAST(ps % 4 AS STRING) ELSE '' END AS technique_id, CASE ps % 5 WHEN 0 THEN 'execution' WHEN 1 THEN 'impact' WHEN 2 THEN 'discovery' ELSE 'collection' END AS tactic,
        CASE WHEN ps % 7 = 0 OR ps % 5 = 1 THEN 'secondary' ELSE 'primary' END AS source, CASE ps % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' ELSE '' END AS platform_list FROM (SELECT s_suppkey AS ps FROM supplier) s""",
    "wanted": """SELECT DISTINCT c_custkey % 40 AS bundle_id, 'T' || CAST(1000 + c_custkey % 53 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '.00' || CAST(c_custkey % 4 AS STRING) ELSE '' END AS technique_id FROM customer""",
    "stix_object": """SELECT doc_id % 50 AS bundle_id, doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN 'attack-pattern' WHEN 1 THEN 'tool' WHEN 2 THEN 'threat-actor' WHEN 3 THEN 'vulnerability' ELSE 'note' END AS type, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 'x--' || md5(CAST(doc_id % 700 AS STRING)) END AS id,
        substr(text, 1, 12) AS name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS description, CASE WHEN doc_id % 5 = 0 THEN 'T' || CAST(1000 + doc_id % 90 AS STRING) END AS tid, CASE WHEN doc_id % 5 = 3 THEN 'about cve-2020-' || CAST(1000 + doc_id % 60 AS STRING) END AS cve_text, lang AS label FROM documents""",
    # documents as files of plan folders
    "plan_file": """SELECT doc_id, length(text) AS size, CASE WHEN p % 7 = 3 THEN '.lib/' ELSE 'lib/' END || 'plan' || CAST(p AS STRING) || '/' || CASE k WHEN 0 THEN CASE WHEN p % 4 = 0 THEN 'Scenario.md' ELSE 'notes.md' END
        WHEN 1 THEN CASE WHEN p % 3 <> 1 THEN 'Emulation_Plan/Day1/Big_Scenario_' || CAST(doc_id AS STRING) || '.md' ELSE 'Emulation_Plan/YAML/x_scenario.md' END WHEN 2 THEN CASE WHEN p % 3 <> 1 THEN 'Emulation_Plan/Phase_' || CAST(doc_id AS STRING) || '.md' ELSE 'Emulation_Plan/README_scenario.md' END
        WHEN 3 THEN CASE WHEN p % 2 = 0 THEN 'Emulation_Plan/README.md' ELSE 'a.md' END WHEN 4 THEN 'README.md' WHEN 5 THEN CASE WHEN p % 3 = 0 THEN 'CTI_Emulation_Resources/Some_Overview.md' ELSE 'CTI_Emulation_Resources/ReadMe.md' END
        WHEN 6 THEN CASE WHEN p % 2 = 0 THEN 'CTI_Emulation_Resources/n' || CAST(doc_id AS STRING) || '.md' ELSE 'CTI_Emulation_Resources/n.txt' END WHEN 7 THEN CASE WHEN p % 5 < 3 THEN 'Intelligence_Summary/s.md' ELSE 'b.md' END WHEN 8 THEN 'Intelligence_Summary.md'
        WHEN 9 THEN 'Emulation_Plan/S2/Infrastructure_' || CAST(doc_id AS STRING) || '.md' WHEN 10 THEN 'Infrastructure.md' ELSE 'Emulation_Plan/a/b/phase_deep.md' END AS path FROM (SELECT doc_id, text, doc_id % 60 AS p, CAST(floor(doc_id / 60) AS BIGINT) % 12 AS k FROM documents) d""",
    "run": """SELECT event_id AS run_id, user_id AS experiment_id, CASE event_type WHEN 'signup' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'FINISHED' END AS status, ts AS start_time, event_type AS stage, value, props FROM events""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a derived input over the tables of ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = INPUTS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql.replace("chr(92)", "char(92)").replace("chr(10)", "char(10)"), **used)


def with_sql(names: tuple[str, ...], body: str) -> str:
    return ("WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names) + " " + body) if names else body
