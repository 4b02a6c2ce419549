"""Model tables of libraries: where untrusted values come from, where they do harm, what clears them, and which calls are reported
as they stand. Symbols are the libraries' public names. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Kinds of taint as bits.
KINDS = {"sql": 1, "command": 2, "html": 4, "path": 8, "ssrf": 16, "code": 32, "deserialization": 64, "redirect": 128, "nosql": 256}
ALL = sum(KINDS.values())

#: Symbols whose values, and whatever is read from them, are untrusted, by library.
SOURCES = {
    "python": ("builtins.input", "sys.argv", "sys.stdin", "os.environ", "os.getenv"),
    "flask": ("flask.request",),
    "django": ("django.http.HttpRequest", "django.http.request.HttpRequest"),
    "fastapi": ("fastapi.Request", "starlette.requests.Request"),
    "aiohttp": ("aiohttp.web.Request",),
    "tornado": ("tornado.web.RequestHandler.get_argument", "tornado.web.RequestHandler.get_body_argument", "tornado.web.RequestHandler.request"),
    "bottle": ("bottle.request",),
}
#: Decorators whose functions get their parameters from outside, by library.
ENTRY_POINTS = {
    "flask": ("flask.Flask.route", "flask.Blueprint.route", "flask.Flask.get", "flask.Flask.post"),
    "fastapi": ("fastapi.FastAPI.get", "fastapi.FastAPI.post", "fastapi.FastAPI.put", "fastapi.APIRouter.get", "fastapi.APIRouter.post"),
    "aiohttp": ("aiohttp.web.RouteTableDef.get", "aiohttp.web.RouteTableDef.post"),
    "bottle": ("bottle.route", "bottle.get", "bottle.post"),
    "click/typer": ("click.command", "typer.Typer.command", "click.Group.command"),
}
#: Decorators whose functions run only for those who may, by library.
AUTHORIZING = {
    "django": ("django.contrib.auth.decorators.login_required", "django.contrib.auth.decorators.permission_required", "django.contrib.auth.decorators.user_passes_test", "django.contrib.admin.views.decorators.staff_member_required"),
    "flask": ("flask_login.login_required", "flask_login.fresh_login_required", "flask_jwt_extended.jwt_required", "flask_security.auth_required", "flask_security.roles_required"),
    "rest_framework": ("rest_framework.decorators.permission_classes",),
    "tornado": ("tornado.web.authenticated",),
}
_HTTP = ("get", "post", "put", "patch", "delete", "head", "options")
#: Base classes whose methods a library calls, by library: (base, methods, attributes that hold what comes from outside, whether
#: the methods' parameters do, too). Fixed values.
BASES = {
    "python": (("http.server.BaseHTTPRequestHandler", ("do_GET", "do_POST", "do_PUT", "do_DELETE", "do_HEAD"), ("path", "headers", "rfile", "requestline"), False), ("socketserver.BaseRequestHandler", ("handle",), ("request",), False)),
    "tornado": (("tornado.web.RequestHandler", _HTTP, ("request", "path_args", "path_kwargs"), True), ("tornado.websocket.WebSocketHandler", ("on_message", "open"), ("request",), True)),
    "django": (("django.views.View", (*_HTTP, "dispatch"), ("request", "args", "kwargs"), True), ("django.views.generic.View", (*_HTTP, "dispatch"), ("request", "args", "kwargs"), True),
               ("django.views.generic.TemplateView", (*_HTTP, "dispatch"), ("request", "args", "kwargs"), True), ("django.views.generic.edit.FormView", (*_HTTP, "dispatch", "form_valid"), ("request", "args", "kwargs"), True)),
    "rest_framework": (("rest_framework.views.APIView", _HTTP, ("request", "args", "kwargs"), True), ("rest_framework.viewsets.ViewSet", ("list", "create", "retrieve", "update", "partial_update", "destroy"), ("request", "args", "kwargs"), True)),
    "flask": (("flask.views.MethodView", _HTTP, (), True), ("flask.views.View", ("dispatch_request",), (), True)),
    "aiohttp": (("aiohttp.web.View", _HTTP, ("request",), False),),
}
#: rule: (kind, severity, [(symbol or dotted suffix, positions that matter or None for all)]).
SINKS = {
    "sql-injection": ("sql", "high", [("execute", [0]), ("executemany", [0]), ("executescript", [0]), ("django.db.models.Manager.raw", [0]), ("sqlalchemy.text", [0])]),
    "command-injection": ("command", "critical", [("os.system", [0]), ("os.popen", [0]), ("subprocess.call", [0]), ("subprocess.run", [0]), ("subprocess.Popen", [0]), ("subprocess.check_output", [0]), ("subprocess.getoutput", [0])]),
    "code-injection": ("code", "critical", [("builtins.eval", [0]), ("builtins.exec", [0]), ("builtins.compile", [0])]),
    "path-traversal": ("path", "high", [("builtins.open", [0]), ("os.remove", [0]), ("os.unlink", [0]), ("shutil.rmtree", [0]), ("flask.send_file", [0])]),
    "ssrf": ("ssrf", "high", [("requests.get", [0]), ("requests.post", [0]), ("requests.put", [0]), ("requests.request", [1]), ("httpx.get", [0]), ("httpx.post", [0]), ("urllib.request.urlopen", [0])]),
    "open-redirect": ("redirect", "medium", [("flask.redirect", [0]), ("django.shortcuts.redirect", [0]), ("django.http.HttpResponseRedirect", [0])]),
    "xss": ("html", "medium", [("flask.render_template_string", [0]), ("markupsafe.Markup", [0]), ("django.utils.safestring.mark_safe", [0]), ("flask.make_response", [0])]),
    "insecure-deserialization": ("deserialization", "critical", [("pickle.loads", [0]), ("pickle.load", [0]), ("marshal.loads", [0]), ("yaml.load", [0]), ("yaml.unsafe_load", [0]), ("jsonpickle.decode", [0])]),
    "nosql-injection": ("nosql", "high", [("find_one", [0]), ("delete_many", [0]), ("update_many", [0])]),
}
#: symbol: kinds that a call clears.
CLEARS = {
    "builtins.int": ALL, "builtins.float": ALL, "builtins.bool": ALL, "builtins.len": ALL, "uuid.UUID": ALL, "shlex.quote": KINDS["command"], "html.escape": KINDS["html"], "markupsafe.escape": KINDS["html"],
    "flask.escape": KINDS["html"], "os.path.basename": KINDS["path"], "werkzeug.utils.secure_filename": KINDS["path"], "flask.url_for": KINDS["redirect"], "hashlib.sha256": ALL,
}
#: rule: (severity, symbols, condition). The condition is SQL over ``kw`` (keyword -> literal), ``pos`` (position -> literal) and
#: ``given`` (keywords that were given); null literals are not known.
CALLS = {
    "weak-crypto": ("medium", ["hashlib.md5", "hashlib.sha1", "Crypto.Cipher.DES.new", "Crypto.Cipher.ARC4.new"], "coalesce(kw['usedforsecurity'], '') <> 'False'"),
    "dangerous-eval": ("medium", ["builtins.eval", "builtins.exec"], "pos[0] IS NULL"),
    "debug-enabled": ("medium", ["flask.Flask.run", "bottle.run"], "kw['debug'] = 'True'"),
    "missing-timeout": ("low", ["requests.get", "requests.post", "requests.put", "requests.delete", "requests.head", "requests.request"], "NOT array_contains(given, 'timeout') AND NOT array_contains(given, '**')"),
    "insecure-tls": ("high", ["requests.get", "requests.post", "requests.put", "requests.delete", "requests.request", "httpx.get", "httpx.post", "httpx.Client"], "kw['verify'] = 'False'"),
    "unsafe-xml": ("medium", ["xml.etree.ElementTree.parse", "xml.etree.ElementTree.fromstring", "xml.dom.minidom.parse", "xml.dom.minidom.parseString", "xml.sax.parse"], "true"),
    "unsafe-archive-extraction": ("high", ["tarfile.open.extractall", "tarfile.open.extract", "tarfile.TarFile.extractall"], "NOT array_contains(given, 'filter')"),
    "insecure-temp-file": ("medium", ["tempfile.mktemp", "os.tempnam"], "true"),
    "weak-random": ("low", ["random.random", "random.randint", "random.choice", "random.choices", "random.randrange", "random.getrandbits"], "true"),
}


def prefixes() -> tuple[str, ...]:
    """All source symbols."""
    return tuple(s for group in SOURCES.values() for s in group)


def sink_table(spark: SparkSession) -> DataFrame:
    """suffix, rule, severity, bits, positions; small and fixed."""
    rows = [(symbol, rule, severity, KINDS[kind], positions) for rule, (kind, severity, symbols) in SINKS.items() for symbol, positions in symbols]
    return spark.createDataFrame(rows, "suffix string, rule string, severity string, bits long, positions array<long>")


def clear_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLEARS.items()), "symbol string, cleared long")


def call_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, rule, severity) for rule, (severity, symbols, _) in CALLS.items() for s in symbols], "symbol string, rule string, severity string")


def entry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for group in ENTRY_POINTS.values() for s in group], "symbol string")


def base_table(spark: SparkSession) -> DataFrame:
    """base, methods, attributes, parameters; small and fixed."""
    rows = [(base, list(methods), list(attributes), given) for group in BASES.values() for base, methods, attributes, given in group]
    return spark.createDataFrame(rows, "base string, methods array<string>, attributes array<string>, parameters boolean")


def source_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in prefixes()], "prefix string")


def authorizing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for group in AUTHORIZING.values() for s in group], "symbol string")
