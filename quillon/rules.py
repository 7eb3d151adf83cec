"""Rules over strings and file paths, compiled to native expressions.

A rule matches a string as ``regex`` (from its start), ``glob`` (as a whole), ``exact`` or
``contains``. A file rule also names its target: the full path, any part of it or the file's name.
All rules become one array expression per row, so a table is read once however many rules there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    pattern: str
    message: str = "n/a"
    score: int = 0
    tags: tuple[str, ...] = ()
    ignore_case: bool = False
    target: str = "full"
    #: A literal that every hit holds; it is looked for before an expression is tried.
    needs: str = ""


def rule_of(spec: str | dict, number: int = 0) -> Rule:
    """A rule from its configuration; a bare string is an exact rule."""
    if isinstance(spec, str):
        return Rule(spec, "exact", spec)
    kind = spec.get("type", "exact")
    if kind not in KINDS:
        raise ValueError(f"no such kind of rule: {kind}")
    return Rule(spec.get("id", f"rule{number}"), kind, spec["pattern"], spec.get("message", "n/a"), int(spec.get("score", 0)), tuple(spec.get("tags", ())), "I" in str(spec.get("flags", "")), spec.get("target", "full"))


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression for ``* ? [set] [!set]``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "]"))
            j += pattern[i : i + 2] == "!]"
            j = pattern.find("]", j)
            if j < 0:
                out.append("\\[")
            else:
                inner = pattern[i:j].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out.append("[^" + inner[1:] + "]" if inner.startswith("!") else "[" + inner + "]")
                i = j + 1
        else:
            out.append("\\" + c if c in "\\.^$+{}()|]" else c)
    return "(?s)^(?:" + "".join(out) + ")\\z"


def _regex(value: Column, rule: Rule) -> Column:
    return value.rlike(f"(?d{'i' if rule.ignore_case else ''})^(?:{rule.pattern})")


KINDS = {
    "regex": _regex,
    "glob": lambda value, rule: value.rlike(glob_regex(rule.pattern)),
    "exact": lambda value, rule: value == rule.pattern,
    "contains": lambda value, rule: value.contains(rule.pattern),
}


def matches(value: Column, rule: Rule) -> Column:
    """Whether the rule hits; null gives false."""
    test = KINDS[rule.kind](value, rule)
    return F.coalesce(value.contains(rule.needs) & test if rule.needs else test, F.lit(False))


def path_matches(path: Column, rule: Rule) -> Column:
    parts = F.split(path, "/")
    if rule.target == "part":
        return F.coalesce(F.exists(parts, lambda p: matches(p, rule)), F.lit(False))
    return matches(F.element_at(parts, -1) if rule.target == "filename" else path, rule)


_HIT = "struct<rule:string,message:string,score:int,tags:array<string>>"


def hits(value: Column, rules: list[Rule], test=matches) -> Column:
    """An array of the rules that hit."""
    every = [F.when(test(value, r), F.struct(F.lit(r.id).alias("rule"), F.lit(r.message).alias("message"), F.lit(r.score).alias("score"), F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags"))) for r in rules]
    return F.array_compact(F.array(*every)) if every else F.array().cast(f"array<{_HIT}>")


def path_tags(path: Column, rules: list[Rule]) -> Column:
    """The sorted union of the tags of all file rules that hit."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits(path, rules, path_matches), lambda h: h["tags"]))))


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 1, line) of each text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def tag_filter(tags: Column, wanted: list[str]) -> Column:
    """``!tag`` must be absent, and of the others, if any, one present; a trailing ``*`` stands for any end. Case and ``-`` for ``_`` don't count."""
    clean = [w.strip().lower().replace("-", "_") for w in wanted]

    def has(w: str) -> Column:
        return F.exists(tags, lambda t: t.startswith(w[:-1]) if w.endswith("*") else t == w)

    out = F.lit(True)
    for w in clean:
        if w.startswith("!"):
            out &= ~has(w[1:])
    some = [has(w) for w in clean if not w.startswith("!")]
    if some:
        any_of = some[0]
        for x in some[1:]:
            any_of |= x
        out &= any_of
    return F.coalesce(out, F.lit(False))


def with_prefixes(tags: Column) -> Column:
    """The tags and all their ``:``-prefixes, sorted."""
    heads = F.transform(tags, lambda t: F.transform(F.sequence(F.lit(1), F.size(F.split(t, ":"))), lambda i: F.array_join(F.slice(F.split(t, ":"), 1, i), ":")))
    return F.array_sort(F.array_distinct(F.flatten(heads)))


def behavior(tags: Column, tree) -> Column:
    """A rule tree over tags: a tag, or {"allOf": [...]}, {"anyOf": [...]}, {"not": tree}."""
    if isinstance(tree, str):
        return F.array_contains(tags, tree)
    (kind, below), *_ = tree.items()
    if kind == "not":
        return ~behavior(tags, below)
    parts = [behavior(tags, x) for x in below]
    out = F.lit(kind == "allOf")
    for x in parts:
        out = out & x if kind == "allOf" else out | x
    return out


STRING_RULES = [
    Rule("secret_token", "regex", '.*token = "[0-9a-f]{40}"', "A secret in the text", 100, ("leak:secret",), needs='token = "'),
    Rule("email", "regex", "(?:.*[^A-Za-z0-9._-])?[a-z0-9._]+@[a-z0-9]+[.][a-z]+", "An e-mail address", 10, ("leak:email", "personal_data"), needs="@"),
    Rule("ipv4", "regex", "(?:.*[^0-9.])?[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "An address of a host", 20, ("network:address",)),
    Rule("license", "contains", "icense", "A license line", 0, ("legal",)),
    Rule("shouting", "glob", "*!!*", "Many exclamation marks", 1, ("style",)),
    Rule("junk", "regex", ".*(?:%%%|###|&&&|[$]{3}|[*]{3})", "Junk characters", 5, ("quality:junk",)),
]
FILE_RULES = [
    Rule("query", "contains", "?", tags=("url:query",)),
    Rule("fragment", "regex", "[^#]*#", tags=("url:fragment",)),
    Rule("language", "regex", "(?:en|fr|de|es)$", tags=("url:language",), target="part"),
    Rule("secure", "glob", "https://*", tags=("url:secure", "scheme:https")),
    Rule("plain", "glob", "http://*", tags=("url:plain", "scheme:http")),
    Rule("folder", "exact", "", tags=("url:folder",), target="filename"),
    Rule("blog", "regex", "https?://blog[.]", tags=("site:blog",)),
]
BEHAVIORS = {
    "leaks_secrets": {"anyOf": ["leak:secret", "leak:email"]},
    "clean_leak": {"allOf": ["leak", {"not": "quality"}]},
    "networked_personal": {"allOf": ["network", {"anyOf": ["personal_data", "leak:secret"]}]},
    "junk_only": {"allOf": ["quality:junk", {"not": {"anyOf": ["leak", "network"]}}]},
}


def _tokens() -> list[Rule]:
    """Keys of services, each as a whole string."""
    w, d = "[A-Za-z0-9]", "[0-9]"
    shapes = {
        "twitter_access_token": f"[1-9]{d}+-{w}{{40}}",
        "facebook_access_token": f"EAACEdEose0cBA{w}+",
        "google_api_key": "AIza[A-Za-z0-9_-]{35}",
        "google_oauth_id": f"{d}+-[A-Za-z0-9_]{{32}}[.]apps[.]googleusercontent[.]com",
        "picatic_api_key": "sk_live_[a-z0-9]{32}",
        "stripe_standard_key": f"sk_live_{w}{{24}}",
        "stripe_restricted_key": f"rk_live_{w}{{24}}",
        "square_access_token": "sq0atp-[A-Za-z0-9_-]{22}",
        "square_oauth_secret": "sq0csp-[A-Za-z0-9_-]{43}",
        "paypal_braintree": "access_token[$]production[$][a-z0-9]{16}[$][a-f0-9]{32}",
        "amazon_mws_auth_token": "amzn[.]mws[.]" + "-".join(f"[a-f0-9]{{{n}}}" for n in (8, 4, 4, 4, 12)),
        "twilio_api_key": "SK[A-Fa-f0-9]{32}",
        "mailgun_api_key": f"key-{w}{{32}}",
        "mailchimp_api_key": f"[a-f0-9]{{32}}-us{d}{{1,2}}",
        "amazon_aws_key": "(?:AKIA|ASIA|AROA|AIDA|AIPA|AGPA|ANPA|ANVA|A3T[A-Z0-9])[A-Z0-9]{16}",
        "pypi_api_key": "pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,1000}",
    }
    return [Rule(k, "regex", v + "$", f"A key: {k.replace('_', ' ')}", 100, ("leak:access_token",)) for k, v in shapes.items()]


#: Rules over the strings of sources.
SOURCE_STRINGS = [
    Rule("all_interfaces", "regex", r"0[.]0[.]0[.]0(?::\d{2,6})?$", "All network interfaces are listened on", 10, ("behavior:public_network_interface",)),
    Rule("tmp_folder", "regex", r"(?:/tmp|/var/tmp|/dev/shm|C:\\{1,2}Windows\\Temp\\)", "A folder for temporary files, by name", 10, ("behavior:temp_file",)),
    Rule("url", "regex", "(?:http|ftp)s?://.{5,}", "An address", 0, ("behavior:url",)),
    Rule("netsh_firewall", "regex", "netsh (?:adv)?firewall", "The firewall of Windows is changed", 10, ("behavior:windows:firewall",)),
    Rule("mac_firewall", "regex", "(?:pfctl|/usr/libexec/ApplicationFirewall/socketfilterfw)", "The firewall of macOS is changed", 0, ("behavior:macos:firewall",)),
    Rule("windows_service", "contains", "SysWOW64", "The folder of Windows services", 10, ("behavior:windows:system_service_folder",)),
    Rule("windows_task_scheduler", "contains", "schtasks", "The task scheduler of Windows", 10, ("behavior:windows:task_scheduler",)),
    Rule("hosts_file", "regex", r"(?:C:\\{1,2}Windows\\System32\\drivers\\etc\\hosts|/etc/hosts)$", "The file of host names", 5, ("behavior:accessing_host_file",)),
    Rule("sudo_command", "regex", "sudo .*$", "A command of the superuser", 20, ("behavior:unix:sudo",)),
    *_tokens(),
]
_SECRET = ("leak:sensitive_file",)
_NAMES = ".htpasswd secret_token.rb kwallet .bash_login .sh_history .mysql_history .dbshell .rediscli_history .viminfo .fetchmailrc database.yml".split()
_PLACES = ".ssh/known_keys .ssh/authorized_keys etc/shadow etc/sudoers Local/Google/Chrome/ .docker/config.json .kube/config .aws/credentials".split()
#: Rules over the paths of files.
PATHS = [
    Rule("test_code", "regex", "test(?:s|_.+)?$", tags=("misc:test_code",), target="part"),
    Rule("ssh_key", "regex", "id_[dr]sa$", tags=("leak:private_key", *_SECRET), target="filename"),
    Rule("bash_history", "exact", ".bash_history", tags=("leak:bash_history", *_SECRET), target="filename"),
    Rule("wallet", "exact", "wallet.dat", tags=("misc:crypto_wallet", *_SECRET), target="filename"),
    *(Rule(f"name:{n}", "exact", n, tags=_SECRET, target="filename") for n in _NAMES),
    *(Rule(f"place:{p}", "contains", p, tags=_SECRET) for p in _PLACES),
    *(Rule(f"ignored:{n}", "exact", n, tags=("misc:ignore_file",), target="filename") for n in (".gitignore", ".travis.yml")),
]
#: What the tags of a whole scan say of it: id to (name, rule tree).
SCAN_BEHAVIORS = {
    "network_access": ("Network access", {"anyOf": ["behavior:public_network_interface", "behavior:network", "vuln:unverified_request", "vuln:tls_unverified"]}),
    "system_execution": ("System execution", {"anyOf": ["behavior:system_execution", "behavior:process"]}),
    "code_execution": ("Code execution", "behavior:code_execution"),
    "file_access": ("Accessing files and directories", {"anyOf": ["behavior:opening_files", "behavior:file_system"]}),
    "windows": ("Windows OS", "behavior:windows"),
    "macos": ("MacOS", "behavior:macos"),
    "unix": ("Unix", "behavior:unix"),
    "low_level_access": ("Low-level OS access", "behavior:ctypes"),
    "obfuscation": ("Obfuscation", {"anyOf": ["behavior:obfuscation", "behavior:accessing_variables"]}),
    "vulnerability": ("Vulnerability", {"allOf": ["vuln", {"not": "misc:test_code"}]}),
    "possible_malware": ("Possible Malware", "behavior:possible_malware"),
}


def behavior_id(name: str, id_: str | None = None) -> str:
    """A behaviour's id: what is given, else its name in lower case with underscores."""
    return id_ or name.lower().replace(" ", "_")
