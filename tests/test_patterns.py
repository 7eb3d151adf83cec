import pytest

from quillon.code.patterns import compiled, matches

HITS = [
    ("import web\nweb.request.body()", "web.request.body()", [2]),
    ("import web\nweb.request.body()", "web.request.body", [2]),
    ("import web\nweb.request.body", "web.request.body()", []),
    ("import http_ as h\nh.send('u', check=False)", "http_.send(..., check=False)", [2]),
    ("import http_ as h\nh.send('u')", "http_.send(...)", [2]),
    ("import http_\nhttp_.send()", "http_.send(...)", [2]),
    ("import http_\nprint(len(http_.send('u')))", "http_.send(...)", [2]),
    ("import http_\nhttp_.send('u')", "http_.send()", []),
    ("import http_\nhttp_.send('u', check=True)", "http_.send(..., check=False)", []),
    ("import http_\nhttp_.send('u', check=1)", "http_.send(..., check=True)", []),
    ("import http_\nhttp_.send('u', check=True)", "http_.send(...)", [2]),
    ("import web\nx = web.request.headers['A']", "web.request.headers", [2]),
    ("import web\nx = web.request", "web.request.headers", []),
    ("import web\nx = web.request.headers.more", "web.request.headers", [2]),
    ("from web import request as r\nx = r.headers", "web.request.headers", [2]),
    ("import web", "import web", [1]),
    ("import web2", "import web", []),
    ("import web.get", "import web", [1]),
    ("import web", "import web.get", []),
    ("from web import get", "import web.get", [1]),
    ("from web.get import x", "import web.get", [1]),
    ("from web import post", "import web.get", []),
    ("import ctypes\nctypes.c_int(64)\nctypes.c_int(65)", "ctypes.c_int(64)", [2]),
    ("x = 'a'\ny = 'b'", "'b'", [2]),
]


@pytest.mark.parametrize("source,pattern,lines", HITS)
def test_patterns(source, pattern, lines):
    assert matches(pattern, source) == lines


@pytest.mark.parametrize("bad", ["", "x = 1", "f(", "f(x)", "f(**k)"])
def test_what_is_no_pattern(bad):
    with pytest.raises(ValueError):
        compiled(bad)


@pytest.mark.parametrize(
    "source,id_,score",
    [("import ctypes\nctypes.windll.kernel32.WriteProcessMemory(1)", "behavior:ctypes:write_process_memory", 100), ("import hashlib as h\nh.md5()", "deprecated:hash", 20), ("globals()", "behavior:accessing_variables", 100), ("from getpass import getuser as g\ng()", "behavior:getuser", 10), ("from ctypes import CFUNCTYPE as c\nx = c(1)", "behavior:possible_malware", 100), ("import os\nos.spawnvpe(1, 'x')", "behavior:system_execution", 50)],
)
def test_rules_in_the_analysis(source, id_, score):
    from quillon.code.analysis import analyze

    assert any(id_ in f["tags"] and f["score"] == score for f in analyze("a.py", source))
