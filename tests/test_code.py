from quillon.code.analysis import Analysis, analyze, entropy
from quillon.code.names import UNKNOWN, Scope, constant
from quillon.functions.redos import is_risky
from quillon.operators.code import import_order

import ast

import pytest


def kinds(source, path="a.py"):
    return {(d["class"], d["line_no"]) for d in analyze(path, source)}


def worth(expression, before=""):
    a = Analysis("x.py", before)
    scope = Scope()
    for s in ast.parse(before).body:
        a.statement(s, scope, {}, None)
    return constant(ast.parse(expression, mode="eval").body, scope)


@pytest.mark.parametrize(
    "expression,before,value",
    [
        ("'a' + 'b'", "", "ab"),
        ("1 + 2", "", 3),
        ("'%s-%d' % (x, 3)", "x = 'q'", "q-3"),
        ("'hello'[1:4]", "", "ell"),
        ("'hello'[::-1]", "", "olleh"),
        ("x['k']", "x = {'k': 5}", 5),
        ("b'YWJj'.decode('base64')", "", b"abc"),
        ("'uryyb'.decode('rot13')", "", "hello"),
        ("'aXb'.replace('X', '-')", "", "a-b"),
        ("chr(ord('a') + 1)", "", "b"),
        ("-3", "", -3),
        ("{**x, 'b': 2}", "x = {'a': 1}", {"a": 1, "b": 2}),
        ("f'{x}!'", "x = 'y'", "y!"),
        ("x", "x = x", UNKNOWN),
        ("unknown + 'a'", "", UNKNOWN),
        ("base64.b64decode('YWJj')", "import base64", b"abc"),
    ],
)
def test_constants(expression, before, value):
    got = worth(expression, before)
    assert got is value if value is UNKNOWN else got == value


@pytest.mark.parametrize(
    "source,hit",
    [
        ("import os as o\no.system('x')", True),
        ("from os import system as s\ns('x')", True),
        ("import os\nf = os.system\nf('x')", True),
        ("getattr(__import__('os'), 'sys' + 'tem')('x')", True),
        ("import subprocess\nsubprocess.call('x', shell=True)", True),
        ("import ox\nox.system('x')", False),
        ("def system(x): pass\nsystem('x')", False),
    ],
)
def test_names(source, hit):
    tags = {t for d in analyze("a.py", source) for t in d["tags"]}
    assert ("behavior:process" in tags) == hit


def test_taint():
    source = """
import os, shlex
from flask import Flask, request
app = Flask(__name__)
def run(c):
    os.system(c)
def ok(c):
    os.system(shlex.quote(c))
@app.route("/<name>/<int:n>")
def view(name, n):
    run(name)
    ok(name)
    os.system(n)
    x = name if n else ""
    eval(x + "!")
    return "hello"
@app.route("/<name>")
def echo(name):
    return name
"""
    assert {n for k, n in kinds(source) if k == "TaintAnomaly"} == {6, 15, 19}


@pytest.mark.parametrize(
    "source,kind",
    [
        ("from Crypto.PublicKey import RSA\nRSA.generate(1024)", "CryptoKeyGeneration"),
        ("import re\nre.compile('(a+)+$')", "ReDoS"),
        ("q = 'SELECT a FROM t WHERE x = %s' % y", "SQLInjection"),
        ("q = 'SELECT a FROM t WHERE x = {}'.format(y)", "SQLInjection"),
        ("class A:\n  def __reduce__(self): pass", "Detection"),
        ("ünï = 1", "NonAsciiCharacters"),
        ("import jinja2\njinja2.Environment()", "JinjaVulnerability"),
        ("print 'two'", "ASTParseError"),
        ("x = '" + "YWJj" * 14 + "'", "Base64Blob"),
        ("from setuptools import setup\nsetup(name='a', cmdclass={})", "SetupScript"),
        ("import socket", "ModuleImport"),
    ],
)
def test_node_checks(source, kind):
    assert kind in {k for k, _ in kinds(source)}


def test_clean_source_and_odd_input():
    assert analyze("a.py", "x = 1\n") == []
    assert analyze("a.py", None) == [] and analyze("a.py", "") == []
    assert kinds("x = '\\x00'\n" + "(" * 500) and analyze("a.py", b"# -*- coding: latin-1 -*-\nx = '\xe9'\n") == []
    assert round(entropy("abcd"), 6) == 2.0 and entropy("") == 0


def test_setup_uses_network():
    assert ("SetupScript", 2) in kinds("import requests\nrequests.get('http://x')", "p/setup.py")


@pytest.mark.parametrize("pattern,risky", [("(a+)+$", True), ("(.*)*x", True), ("[a-z]+", False), ("(a|b)c", False), ("(a|aa)+", True), ("(", False), (None, False)])
def test_redos(pattern, risky):
    assert is_risky(pattern) == risky


def test_import_order():
    order = import_order([("a", "b"), ("b", "c"), ("d", "a"), ("e", "e")])
    assert order.index("c") < order.index("b") < order.index("a") < order.index("d")
    assert sorted(import_order([("x", "y"), ("y", "x")])) == ["x", "y"]


def test_pq_grams():
    from quillon.code.pqgrams import distance, pq_grams

    a, b, c = (pq_grams(ast.parse(x)) for x in ("x = f(1) + 2", "y = g(3) + 4", "for i in z: print(i)"))
    assert distance(a, b) == 0 and 0 < distance(a, c) <= 1 and distance(a, a) == 0
    assert pq_grams(ast.parse(""))[("*", "Module", "*", "*", "*")] == 1
