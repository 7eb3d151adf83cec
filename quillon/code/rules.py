"""Rules over calls, imports and data flow."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CallRule:
    """Hits a call by its full name (or a name below it, if it ends with ``.*``); keywords must have the given constants."""

    id: str
    names: tuple[str, ...]
    message: str
    score: int = 0
    tags: tuple[str, ...] = ()
    keywords: dict = field(default_factory=dict, hash=False)
    n_args: int | None = None

    def hits(self, name: str, n_args: int, keywords: dict) -> bool:
        if not any(name == n or n.endswith(".*") and name.startswith(n[:-1]) for n in self.names):
            return False
        if self.n_args is not None and n_args != self.n_args:
            return False
        return all(keywords.get(k, None) == v for k, v in self.keywords.items())


CALLS = (
    CallRule("eval_exec", ("eval", "exec", "builtins.eval", "builtins.exec", "execfile"), "Code is made from text and run", 20, ("behavior:code_execution",)),
    CallRule("os_command", ("os.system", "os.popen", "os.exec.*", "pty.spawn", "commands.getoutput"), "A command of the system is run", 10, ("behavior:process",)),
    CallRule("process", ("subprocess.*",), "A process is started", 5, ("behavior:process",)),
    CallRule("shell", ("subprocess.*",), "A process is started through a shell", 50, ("behavior:process", "vuln:shell_injection"), {"shell": True}),
    CallRule("unpickle", ("pickle.load", "pickle.loads", "cPickle.loads", "marshal.loads", "shelve.open", "dill.loads"), "Objects are made from data", 10, ("behavior:deserialization",)),
    CallRule("yaml_load", ("yaml.load", "yaml.unsafe_load"), "Objects are made from YAML", 10, ("behavior:deserialization",)),
    CallRule("no_verify", ("requests.*", "urllib3.*", "httpx.*"), "A certificate isn't verified", 20, ("vuln:tls_unverified",), {"verify": False}),
    CallRule("temp_name", ("tempfile.mktemp", "os.tempnam", "os.tmpnam"), "A temporary name that others may take first", 10, ("vuln:mktemp",)),
    CallRule("network", ("socket.socket", "urllib.request.*", "urllib2.*", "requests.*", "httpx.*", "http.client.*", "ftplib.*"), "The network is used", 0, ("behavior:network",)),
    CallRule("weak_hash", ("hashlib.md5", "hashlib.sha1"), "A weak hash", 0, ("crypto:weak_hash",)),
    CallRule("file_write", ("shutil.rmtree", "os.remove", "os.unlink", "os.chmod"), "Files are changed", 0, ("behavior:file_system",)),
    CallRule("dynamic_import", ("__import__", "importlib.import_module"), "A module is imported by name", 5, ("behavior:dynamic_import",)),
    CallRule("debug_on", ("flask.Flask.run",), "The debugger is open to users", 20, ("vuln:debug",), {"debug": True}),
    CallRule("environment", ("os.getenv", "os.environ.*"), "The environment is read", 0, ("behavior:environment",)),
)
#: Rules as patterns: an id, patterns, a message, a score, tags.
PATTERNS = (
    ("flask_debug", ("flask.Flask.run(..., debug=True)",), "A web application runs with its debugger", 10, ("vuln:flask:debug_enabled",)),
    ("virtual_alloc", ("ctypes.windll.kernel32.VirtualAlloc",), "Memory is allocated by foreign functions", 0, ("behavior:ctypes:memory_alloc",)),
    ("threads", ("ctypes.windll.kernel32.CreateThread", "ctypes.windll.kernel32.CreateRemoteThread"), "Foreign functions start a thread", 0, ("behavior:ctypes:create_thread",)),
    ("write_memory", ("ctypes.windll.kernel32.WriteProcessMemory",), "The memory of a process is written", 100, ("behavior:ctypes:write_process_memory",)),
    ("window_hook", ("ctypes.windll.user32.SetWindowsHookExA",), "Input of windows is hooked, as key loggers do", 100, ("behavior:ctypes:window_hook",)),
    ("lock_screen", ("ctypes.windll.user32.LockWorkStation",), "The screen is locked", 50, ("behavior:ctypes:lock_workstation",)),
    ("is_admin", ("ctypes.windll.shell32.IsUserAnAdmin",), "It is asked whether the user is an administrator", 100, ("behavior:ctypes:is_admin",)),
    ("enum_windows", ("ctypes.windll.user32.EnumWindows",), "Open windows are listed", 10, ("behavior:ctypes:enum_windows",)),
    ("rwx_page", ("ctypes.c_int(64)",), "A page that may be written and run", 0, ("behavior:ctypes:rwx_memory_page",)),
    ("move_memory", ("ctypes.windll.kernel32.RtlMoveMemory(...)",), "Memory is copied between pages", 0, ("behavior:ctypes:rtl_move_memory",)),
    ("wait_object", ("ctypes.windll.kernel32.WaitForSingleObject",), "An object is waited for", 0, ("behavior:ctypes:wait_for_single_object",)),
    ("volume_information", ("ctypes.windll.kernel32.GetVolumeInformationW",), "A volume is asked for", 0, ("behavior:ctypes:volume_information",)),
    ("function_pointer", ("ctypes.CFUNCTYPE",), "Data can be called as a function", 100, ("behavior:ctypes:function_pointer", "behavior:possible_malware")),
    ("opened", ("open(...)",), "A file is opened", 0, ("behavior:opening_files",)),
    ("md5", ("hashlib.md5",), "MD5 is broken", 20, ("deprecated:hash",)),
    ("variables", ("globals()", "locals()"), "All variables of a scope are taken", 100, ("behavior:accessing_variables",)),
    ("user_name", ("getpass.getuser",), "The user's name is asked for", 10, ("behavior:getuser",)),
    ("start_file", ("os.startfile(...)", "os.popen2(...)", "os.popen3(...)", "os.popen4(...)"), "A command of the system is run", 50, ("behavior:system_execution",)),
    ("spawn", tuple(f"os.spawn{x}(...)" for x in ("l", "le", "lp", "lpe", "v", "ve", "vp", "vpe")), "A command of the system is run", 50, ("behavior:system_execution",)),
    ("django_view", ("django.shortcuts.render(...)",), "A view of a web application", 0, ("django_view",)),
)
_NETWORK, _RUN = ("behavior:network",), ("behavior:code_execution",)
IMPORTS = {
    **dict.fromkeys("socket requests urllib urllib2 urllib3 httplib twisted".split(), _NETWORK),
    **dict.fromkeys("importlib cPickle imp imputil zipimport runpy subprocess popen2 commands".split(), _RUN),
    "pickle": ("behavior:code_execution", "behavior:deserialization"),
    "marshal": ("behavior:code_execution", "behavior:deserialization"),
    "ftplib": ("behavior:network", "vuln:clear_text"),
    "telnetlib": ("vuln:clear_text",),
    "ctypes": ("behavior:native_code",),
    "base64": ("behavior:obfuscation",),
    "winreg": ("behavior:registry", "behavior:windows"),
    "_winreg": ("behavior:windows",),
    "Crypto": ("crypto:library",),
    "django.shortcuts.render": ("misc:django",),
}

SOURCES = ("input", "raw_input", "sys.argv", "os.environ", "os.getenv", "flask.request", "request.args", "request.form", "request.GET", "request.POST", "django.http.HttpRequest")
SINKS = ("flask.jsonify", "flask.db.execute", "flask.make_response.set_cookie", "MySQLdb.connect.cursor.execute", "mysql.connector.connect.cursor.execute", "pymysql.connect.cursor.execute", "psycopg2.connect.cursor.execute", "sqlalchemy.orm.scoped_session.execute", "sqlite3.connect.execute", "django.shortcuts.render", "django.http.HttpResponseNotFound", "shutil.*", "pickle.load", "cPickle.load", "cPickle.loads", "os.startfile", "os.exec.*", "__import__", "importlib.import_module", "eval", "exec", "os.system", "os.popen", "subprocess.*", "flask.render_template_string", "flask.redirect", "flask.send_file", "flask.make_response", "django.http.HttpResponse", "jinja2.Template", "open", "pickle.loads", "cursor.execute", "sqlite3.connect.cursor.execute", "sqlalchemy.text", "flask.Markup", "markupsafe.Markup", "yaml.load")
CLEANERS = ("flask.Markup.escape", "shlex.escape", "int", "float", "len", "bool", "shlex.quote", "pipes.quote", "html.escape", "flask.escape", "markupsafe.escape", "cgi.escape", "os.path.basename", "werkzeug.utils.secure_filename", "urllib.parse.quote")
#: Key makers: where the size is, and below which it is too small.
KEYS = {
    "Crypto.PublicKey.RSA.generate": ("bits", 0),
    "Crypto.PublicKey.DSA.generate": ("bits", 0),
    "Cryptodome.PublicKey.RSA.generate": ("bits", 0),
    "Cryptodome.PublicKey.DSA.generate": ("bits", 0),
    "cryptography.hazmat.primitives.asymmetric.rsa.generate_private_key": ("key_size", 1),
    "cryptography.hazmat.primitives.asymmetric.dsa.generate_private_key": ("key_size", 0),
    "rsa.newkeys": ("nbits", 0),
    "M2Crypto.RSA.gen_key": ("bits", 0),
}
LEAST_KEY = 2048


def under(name: str, names: tuple[str, ...]) -> bool:
    """Whether ``name`` is one of the names, or lies below one of them."""
    return any(name == n or name.startswith((n[:-1] if n.endswith(".*") else n + ".")) for n in names)
