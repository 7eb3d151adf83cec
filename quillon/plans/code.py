"""Python sources made of the documents, analysed.

A document's whole text stands in its source as a constant; what follows is one of the PROGRAMS, by the document's number, some
comment lines further down. What is expected of each program is written down beside it, so a rule that is lost shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import code
from quillon.plans.scans import documents
from quillon.registry import query

#: Each program: its lines; (class, score, line) of what is found; the calls; the imports.
PROGRAMS = (
    ("import os\nname = input()\nos.system('ls ' + name)", [("TaintAnomaly", 10, 3), ("FunctionCall", 10, 3)], ["input", "os.system"], ["os"]),
    ("from os import system as run\nrun('ls')", [("FunctionCall", 10, 2)], ["os.system"], ["os.system"]),
    ("import subprocess as sp\nsp.call('ls', shell=True)", [("FunctionCall", 5, 2), ("FunctionCall", 50, 2)], ["subprocess.call"], ["subprocess"]),
    ("import subprocess\nsubprocess.call(['ls'], shell=False)", [("FunctionCall", 5, 2)], ["subprocess.call"], ["subprocess"]),
    ("from flask import Flask\napp = Flask('x')\n@app.route('/v/<name>')\ndef v(name):\n    return 'Hi ' + name", [("TaintAnomaly", 10, 5)], ["flask.Flask", "flask.Flask.route"], ["flask.Flask"]),
    ("from flask import Flask\napp = Flask('x')\n@app.route('/v/<int:name>')\ndef v(name):\n    return name", [], ["flask.Flask", "flask.Flask.route"], ["flask.Flask"]),
    ("import pickle\ndef f(x):\n    return pickle.loads(x)\nf(b'a')", [("FunctionCall", 10, 3)], ["pickle.loads", "f"], ["pickle"]),
    ("q = 'SELECT a FROM b WHERE c = ' + input()", [("SQLInjection", 50, 1)], ["input"], []),
    ("import os\nn = int(input())\nos.system('echo %d' % n)", [("FunctionCall", 10, 3)], ["int", "input", "os.system"], ["os"]),
    ("import requests as r\nr.get('http://x', verify=False)", [("FunctionCall", 0, 2), ("FunctionCall", 20, 2)], ["requests.get"], ["requests"]),
    ("import hashlib\nx = hashlib.sha256(b'x')", [], ["hashlib.sha256"], ["hashlib"]),
    ("import ctypes\nctypes.windll.kernel32.WriteProcessMemory(1)", [("FunctionCall", 100, 2)], ["ctypes.windll.kernel32.WriteProcessMemory"], ["ctypes"]),
    ("import os\ndef a(x):\n    return b(x)\ndef b(x):\n    os.popen(x)\na(input())", [("TaintAnomaly", 10, 5), ("FunctionCall", 10, 5)], ["b", "os.popen", "a", "input"], ["os"]),
    ("import tempfile\nx = tempfile.mktemp()\ny = globals()", [("FunctionCall", 10, 2), ("FunctionCall", 100, 3)], ["tempfile.mktemp", "globals"], ["tempfile"]),
    ("def f(:", [], [], []),
)
_N, _PADS = len(PROGRAMS), 7


def _sources(spark, sf_dir):
    """A source for each document: its text, up to six comment lines, its program."""
    text = F.concat(F.lit("TEXT = "), F.to_json(F.struct("text")), F.lit("\n"))
    pad = F.repeat(F.lit("#\n"), (F.col("doc_id") % _PADS).cast("int"))
    program = F.element_at(F.array(*(F.lit(p[0] + "\n") for p in PROGRAMS)), (F.col("doc_id") % _N + 1).cast("int"))
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(text, pad, program).alias("source"))


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)


_FOUND = [(k, *f) for k, p in enumerate(PROGRAMS) for f in p[1]]
_CALLS = [(k, c) for k, p in enumerate(PROGRAMS) for c in p[2]]
_IMPORTS = [(k, m) for k, p in enumerate(PROGRAMS) for m in p[3]]


@query(f"SELECT doc_id::VARCHAR AS file_id, class, score, (line + 1 + doc_id % {_PADS})::INTEGER AS line_no FROM documents JOIN (VALUES {_values(_FOUND)}) AS v(k, class, score, line) ON doc_id % {_N} = k")
def code_detections(spark, sf_dir):
    return code.detections(_sources(spark, sf_dir)).where("NOT informational").select("file_id", "class", "score", "line_no")


@query(f"""WITH v(k, name) AS (VALUES {_values(_CALLS)}) SELECT name, count(*) AS n FROM documents JOIN v ON doc_id % {_N} = k GROUP BY name""")
def code_calls(spark, sf_dir):
    return code.calls(_sources(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH v(k, module) AS (VALUES {_values(_IMPORTS)}) SELECT module, count(*) AS n FROM documents JOIN v ON doc_id % {_N} = k GROUP BY module")
def code_imports(spark, sf_dir):
    return code.imports(_sources(spark, sf_dir)).groupBy("module").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id::VARCHAR AS file_id, CASE WHEN doc_id % {_N} < {_N - 1} THEN (doc_id % {_N})::INTEGER END AS model FROM documents")
def code_structure(spark, sf_dir):
    """The program that a source's structure is that of, whatever its strings say; sources that can't be read have none."""
    t = code.structure(_sources(spark, sf_dir))
    own = spark.createDataFrame([(str(k), 'TEXT = {"text": "a"}\n' + p[0]) for k, p in enumerate(PROGRAMS)], "file_id string, source string")
    models = code.structure(own).select(F.col("file_id").cast("int").alias("model"), F.col("grams").alias("of"))
    # A structure that two programs share goes to the number of the source.
    same = t.join(models, F.col("grams") == F.col("of"), "left")
    best = F.min(F.struct((F.col("model") != F.col("file_id").cast("long") % _N).alias("other"), "model"))
    return same.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.model")


_FILES = ["home/.ssh/authorized_keys", "pkg/.hidden", "pkg/x.pyc", "tests/a.dat", "b/wallet.dat", "c/requirements.txt", "d/plain.bin", "e/id_rsa"]
_N_FILES = len(_FILES)
_PLACE = f"{_FILES!r}[(doc_id % {_N_FILES} + 1)::INTEGER]"


@query(f"""WITH f AS (SELECT doc_id::VARCHAR || '/' || {_PLACE} AS path, doc_id % {_N_FILES} AS k, doc_id % 3 AS pin, text FROM documents),
found AS (
  SELECT path, 'FileStats' AS class, 0 AS score, md5(CASE WHEN k = 5 THEN ['flask', 'flask==1.0', 'flask @ https://x/f.zip'][(pin + 1)::INTEGER] ELSE text END) AS md5 FROM f
  UNION ALL SELECT path, 'SensitiveFile', 100, NULL FROM f WHERE k IN (0, 4, 7) UNION ALL SELECT path, 'FileTag', 0, NULL FROM f WHERE k = 3
  UNION ALL SELECT path, 'SuspiciousFile', 5, NULL FROM f WHERE k IN (1, 2)
  UNION ALL SELECT path, 'UnpinnedPackage', 10, NULL FROM f WHERE k = 5 AND pin = 0 UNION ALL SELECT path, 'InvalidRequirement', 20, NULL FROM f WHERE k = 5 AND pin = 2)
SELECT path, class, score, md5, CASE WHEN score >= 100 THEN 'critical' WHEN class = 'UnpinnedPackage' THEN 'high' WHEN score >= 20 THEN 'medium' WHEN score >= 1 THEN 'low' ELSE 'unknown' END AS severity FROM found""")
def scan_files(spark, sf_dir):
    """The scan of a tree of files with the documents' texts: kinds, digests, secrets, odd files, requirements."""
    from quillon.plans import scan

    place = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("doc_id") % _N_FILES + 1).cast("int"))
    pins = F.element_at(F.array(*map(F.lit, ("flask", "flask==1.0", "flask @ https://x/f.zip"))), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.when(F.col("doc_id") % _N_FILES == 5, pins).otherwise(F.col("text"))
    path = F.concat_ws("/", F.col("doc_id").cast("string"), place)
    t = documents(spark, sf_dir).select(path.alias("file_id"), path.alias("path"), F.lit(0).alias("depth"), F.encode(text, "UTF-8").alias("content"))
    found = scan.finished(scan.scan_files(t, F.lit("tree"), only=["files", "paths", "stats"]))
    return found.where("class <> 'Behavior' AND class <> 'ByteMatch' AND class <> 'MalformedXML'").select(F.col("file_id").alias("path"), "class", "score", F.get_json_object("extra", "$.md5").alias("md5"), "severity")


@query(f"""WITH v(k, id) AS (VALUES {_values([(0, 'system_execution'), (1, 'system_execution'), (2, 'system_execution'), (2, 'code_execution'), (3, 'system_execution'), (3, 'code_execution'), (6, 'code_execution'), (8, 'system_execution'), (9, 'network_access'), (11, 'low_level_access'), (12, 'system_execution'), (13, 'obfuscation')])}),
vuln(k) AS (VALUES (2), (7), (9), (13))
SELECT doc_id::VARCHAR AS scan_id, id FROM documents JOIN v ON doc_id % {_N} = k UNION ALL SELECT doc_id::VARCHAR, 'vulnerability' FROM documents JOIN vuln ON doc_id % {_N} = k""")
def scan_behaviors(spark, sf_dir):
    """What the sources do, each a scan of its own, by the tags of its detections."""
    from quillon.operators import detections as det

    t = code.detections(_sources(spark, sf_dir)).withColumn("scan_id", F.col("file_id"))
    return det.behaviors(t).select("scan_id", "id")
