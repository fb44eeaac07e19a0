"""Agent configuration: structured checks of server entries (D-THR2)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.session import ship

# Rule ids, severities and the words that they are told by.
SHELLS = ("bash", "sh", "zsh", "cmd", "cmd.exe", "powershell", "powershell.exe", "pwsh")
SHELL_FLAGS = ("-c", "/c", "-command", "-encodedcommand", "-enc")
LAUNCHERS = ("npx", "npx.cmd", "uvx", "pipx", "bunx", "pnpx")
CREDENTIAL_NAME = r"(?i)(?:authorization|api[_-]?key|access[_-]?token|client[_-]?secret|password)"
CREDENTIAL_REFERENCE = r"(?i)(?:\$\{|\$env:|process\.env|os\.environ|secret://|env://)"
CREDENTIAL_PLACEHOLDER = r"(?i)^[\"']?(?:(?:bearer|basic|token)\s+)?(?:<[^<>]{1,96}>|(?:api_key|changeme|change_me|client_secret|dummy|example|insert_here|password|paste_here|placeholder|replace_me|secret|token|x{3,5})(?:_(?:here|value))?|(?:your|example|sample|dummy|fake)_\w*(?:api_?key|access_?token|client_?secret|password|secret|token|key))?[\"']?$"
APPROVAL_KEYS = ("autoapprove", "auto_approve", "alwaysallow", "always_allow", "dangerouslyskippermissions", "dangerously_skip_permissions", "skipapproval", "skip_approval")
SCOPE_KEYS = ("roots", "root", "directories", "alloweddirectories", "allowed_directories", "workspacepaths", "workspace_paths", "mounts", "volumes", "filesystem")
BROAD_PATH = r"^(?:/|~|~/|/home|/users|c:/users|[a-z]:/users/[^/]+/?)$|/\.ssh|/\.aws|/\.kube|/var/run/docker\.sock"
PRIVILEGED = r"--privileged|--pid[= ]host|--network[= ]host|--ipc[= ]host|docker\.sock|(?:-v|--volume)[= ]/:"
MUTABLE_GIT = r"(?:git\+|github:|github\.com/|gitlab\.com/|bitbucket\.org/)"
ACTIVATION_DEPENDENT = ("MCP_AUTOMATIC_TOOL_APPROVAL", "MCP_INSECURE_REMOTE_TRANSPORT", "MCP_MUTABLE_GIT_SOURCE", "MCP_OVERBROAD_FILESYSTEM_SCOPE", "MCP_PRIVILEGED_CONTAINER_SURFACE", "MCP_SHELL_WRAPPER_EXECUTION", "MCP_UNPINNED_PACKAGE_EXECUTION")
# End of the fixed values.

#: A document beyond one of these bounds is reported as incomplete: depth, entries of a container or server map, named values.
MAX_DEPTH, MAX_SERVERS, MAX_VALUES = 8, 256, 1024
_SERVER_KEYS = ("mcpServers", "mcp_servers", "servers")
_WALK = "struct<servers:array<struct<name:string,body:string>>,gaps:array<string>>"


def parse_document(text: str, path: str = "") -> object | None:
    """A configuration as nested values: JSON (comments allowed), TOML, or YAML where a parser for it is installed; nothing if it is none of them."""
    import tomllib

    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("toml", "yaml", "yml"):
        for body in (text, _without_comments(text)):
            try:
                return json.loads(body)
            except (ValueError, RecursionError):
                continue
    if suffix in ("toml", "") or "=" in text:
        try:
            return tomllib.loads(text)
        except (ValueError, RecursionError):
            pass
    if suffix in ("yaml", "yml") or any(f"{k}:" in text for k in _SERVER_KEYS):
        try:
            import yaml
        except ImportError:
            return None
        try:
            return yaml.safe_load(text)
        except (yaml.YAMLError, RecursionError, ValueError):
            return None
    return None


def _without_comments(text: str) -> str:
    """JSON without // and /* */ comments outside strings, and without commas before a closing bracket."""
    import re

    pieces = re.findall(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[^"/]+|.', text, re.S)
    kept = "".join(" " if p.startswith(("//", "/*")) else p for p in pieces)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], kept)


def walk_document(document: object) -> dict:
    """Server entries at any depth up to ``MAX_DEPTH``, each as JSON, and which bounds the document passes.

    A bound is reported, it drops no server that was reached: beyond the depth nothing is looked at.
    """
    servers: list[dict] = []
    gaps: set[str] = set()
    values = 0
    stack: list[tuple[object, int]] = [(document, 0)]
    while stack:
        node, depth = stack.pop()
        if not isinstance(node, (dict, list)):
            continue
        if depth > MAX_DEPTH:
            gaps.add("depth_limit")
            continue
        values += len(node)
        if len(node) > MAX_SERVERS:
            gaps.add("container_entry_limit")
        if isinstance(node, list):
            stack += [(child, depth + 1) for child in reversed(node)]
            continue
        for key, child in reversed(node.items()):
            stack.append((child, depth + 1))
        for key, child in node.items():
            if key in _SERVER_KEYS and isinstance(child, dict):
                servers += [{"name": str(name), "body": json.dumps(body, ensure_ascii=False, default=str)} for name, body in child.items() if isinstance(body, dict)]
    if values > MAX_VALUES:
        gaps.add("named_value_limit")
    if len(servers) > MAX_SERVERS:
        gaps.add("server_entry_limit")
    return {"servers": servers, "gaps": sorted(gaps)}


def agent_config(configs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row for each rule and server of JSON, TOML or YAML configurations: keys, server, rule_id, severity, confidence.

    A server is an object under mcpServers, mcp_servers or servers at any depth up to ``MAX_DEPTH``; ``path``
    names a column that tells the format by its suffix. A server's fields, and those of its env
    and headers, are read as a map of texts; what a rule asks of nested values it asks of their JSON. Rules
    that depend on activation are of medium confidence for a disabled server. Texts of no such format give
    no row. A document beyond one of the bounds gives MCP_CONFIG_STRUCTURE_INCOMPLETE too; all servers that were reached, and all their
    values, are looked at all the same.
    """
    ship(configs.sparkSession)
    keys = [c for c in configs.columns if c != text]

    @F.pandas_udf(_WALK)
    def walked(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [walk_document(parse_document(t, p or "")) for t, p in zip(texts, paths, strict=True)]
        return pd.DataFrame({"servers": [f["servers"] for f in found], "gaps": [f["gaps"] for f in found]})

    # Native: only texts that name a server map can hold one.
    named_map = configs.filter(F.col(text).rlike("mcpServers|mcp_servers|servers"))
    rows = named_map.select(*keys, walked(F.col(text), F.col(path) if path else F.lit("")).alias("w")).select(*keys, "w.*")
    each = rows.select(*keys, F.explode("servers").alias("s")).select(*keys, F.col("s.name").alias("server"), F.from_json("s.body", "map<string,string>").alias("m")).filter("m is not null")
    field = lambda name: F.coalesce(F.col("m")[name], F.lit(""))
    parts = lambda name: F.coalesce(F.from_json(F.col("m")[name], "array<string>"), F.array().cast("array<string>"))
    nested = lambda name: F.coalesce(F.from_json(F.col("m")[name], "map<string,string>"), F.create_map().cast("map<string,string>"))
    command = F.lower(F.regexp_replace(F.replace(field("command"), F.lit("\\"), F.lit("/")), "^.*/", ""))
    named = F.concat(F.map_entries("m"), F.map_entries(nested("env")), F.map_entries(nested("headers")))
    wide = each.select(*keys, "server", command.alias("command"), parts("args").alias("args"), F.array_join(parts("args"), " ").alias("line"), named.alias("named"), F.coalesce(F.col("m")["url"], F.col("m")["serverUrl"], F.col("m")["endpoint"], F.lit("")).alias("url"), field("disabled").alias("disabled"), field("enabled").alias("enabled"))
    low_args = F.transform("args", F.lower)
    package = F.get(F.filter("args", lambda a: ~a.startswith("-")), 0)
    pinned = package.rlike(r"(?:@|==)v?\d+(?:\.\d+)+[\w.+-]*$")
    git = F.exists(F.concat("args", F.array("url")), lambda a: a.rlike(f"(?i){MUTABLE_GIT}") & ~a.rlike("(?i)[@#][0-9a-f]{40}$"))
    local = package.rlike(r"^(?:\.{1,2}$|\.{0,2}/|file:|link:|workspace:)") | package.rlike(f"(?i){MUTABLE_GIT}")
    is_true = lambda v: F.lower(F.trim(v)).isin("true", "all", "always", "*", "1", "yes")
    filled = lambda v: v.rlike(r"^\s*[\[{]") & ~v.rlike(r"^\s*(?:\[\s*\]|\{\s*\})\s*$")
    host = F.regexp_extract(F.lower("url"), r"^http://(\[[^\]]*\]|[^/:?#]*)", 1)
    credential = F.exists("named", lambda e: e["key"].rlike(CREDENTIAL_NAME) & (F.trim(e["value"]) != "") & ~e["value"].rlike(r"^\s*[\[{]") & ~e["value"].rlike(CREDENTIAL_REFERENCE) & ~e["value"].rlike(CREDENTIAL_PLACEHOLDER))
    broad_values = F.flatten(F.transform(F.filter("named", lambda e: F.lower(e["key"]).isin(*SCOPE_KEYS)), lambda e: F.coalesce(F.from_json(e["value"], "array<string>"), F.array(e["value"]))))
    broad = F.exists(F.concat(broad_values, F.col("args")), lambda v: F.lower(F.trim(F.replace(v, F.lit("\\"), F.lit("/")))).rlike(BROAD_PATH)) | F.lower("line").rlike(r"(?:^|\s)(?:-v|--volume)[=\s]+/:")
    container = F.col("command").isin("docker", "podman", "nerdctl") | F.exists("args", lambda a: F.lower(a).isin("docker", "podman", "nerdctl"))
    tests = (
        ("MCP_SHELL_WRAPPER_EXECUTION", "high", F.col("command").isin(*SHELLS) & F.arrays_overlap(low_args, F.array(*map(F.lit, SHELL_FLAGS)))),
        ("MCP_UNPINNED_PACKAGE_EXECUTION", "high", F.col("command").isin(*LAUNCHERS) & package.isNotNull() & ~pinned & ~local),
        ("MCP_INSECURE_REMOTE_TRANSPORT", "high", F.lower("url").startswith("http://") & ~host.isin("localhost", "127.0.0.1", "[::1]")),
        ("MCP_STATIC_CREDENTIAL_IN_CONFIG", "high", credential),
        ("MCP_AUTOMATIC_TOOL_APPROVAL", "critical", F.exists("named", lambda e: F.lower(e["key"]).isin(*APPROVAL_KEYS) & (is_true(e["value"]) | filled(e["value"])))),
        ("MCP_OVERBROAD_FILESYSTEM_SCOPE", "high", broad),
        ("MCP_PRIVILEGED_CONTAINER_SURFACE", "critical", container & F.lower(F.concat_ws(" ", "command", "line")).rlike(PRIVILEGED)),
        ("MCP_MUTABLE_GIT_SOURCE", "high", git),
    )
    off = is_true(F.col("disabled")) | F.lower(F.trim("enabled")).isin("false", "no", "0")
    row = lambda rule, severity: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), (F.when(off, "medium").otherwise("high") if rule in ACTIVATION_DEPENDENT else F.lit("high")).alias("confidence"))
    hits = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), row(rule, severity)) for rule, severity, test in tests]))
    found = wide.select(*keys, "server", F.explode(hits).alias("r")).select(*keys, "server", "r.*")
    over = rows.filter(F.size("gaps") > 0).select(*keys, F.lit("").alias("server"), F.lit("MCP_CONFIG_STRUCTURE_INCOMPLETE").alias("rule_id"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"))
    return found.unionByName(over)


PRIVATE_KEYS = (  # fixed values
    "users", "customers", "members", "patients", "userid", "customerid", "memberid", "patientid", "accountid", "ownerid", "tenantid", "orderid",
    "paymentid", "residentregistrationnumber", "rrn", "diagnosis", "medicalinfo", "password", "accesstoken", "refreshtoken", "secret", "role", "permissions",
)


def private_json(body: Column, nodes: int = 2_000) -> Column:
    """D-HTTP3: does a JSON body hold one of the private keys among its first ``nodes`` keys, at any depth?

    Keys are compared by their letters and digits, in lower case. Texts that are no JSON hold none.
    """
    names = F.slice(F.regexp_extract_all(body, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)), 1, nodes)
    private = F.exists(names, lambda k: F.lower(F.regexp_replace(k, "[^\\p{L}\\p{N}]", "")).isin(*PRIVATE_KEYS))
    return F.coalesce(F.try_parse_json(body).isNotNull() & private, F.lit(False))
