"""Source files to graph rows (rows X1-X16, X22, X23, H15, H16): one pass over files, then joins for imports.

Per file, executors emit tagged rows: symbols, calls and import specifiers. Python is parsed with the standard library; Go and
TypeScript/JavaScript with scanners of their own, which strip comments and strings and follow braces. They read declarations
at any depth but no types; calls inside arrow functions have no caller.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.identity import file_node_id, project_node_id
from codeloom.functions.text import extension, is_code_file
from codeloom.operators.graph import Graph
from codeloom.session import numbered

_ROW = "path string, part string, name string, kind string, target string, location string, seq long"

Row = tuple[str, str, str, str, str]  # part, name, kind, target, location


def python_rows(source: str) -> list[Row]:
    """Functions and classes at any depth, methods too; a call belongs to the innermost function."""
    rows: list[Row] = []

    def callee(f: ast.expr) -> str:
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""

    def visit(node: ast.AST, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                rows.append(("symbol", child.name, "function", "", f"L{child.lineno}"))
                visit(child, child.name)
                continue
            if isinstance(child, ast.ClassDef):
                rows.append(("symbol", child.name, "struct", "", f"L{child.lineno}"))
            elif isinstance(child, ast.Call) and inside and (name := callee(child.func)):
                rows.append(("call", inside, "calls", name, f"L{child.lineno}"))
            visit(child, inside)

    visit(ast.parse(source), "")
    for line in source.splitlines():
        words = line.split()
        if len(words) > 1 and words[0] in ("from", "import"):
            module = words[1].split(",")[0] if words[0] == "import" else words[1]
            if "." in module and not module.startswith("."):
                rows.append(("import", module.replace(".", "/") + ".py", "path", "", ""))
    return rows


_GO_PLAIN = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_TS_PLAIN = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def _blanked(pattern: re.Pattern, source: str) -> str:
    """Comments and strings replaced by blanks of the same length, line ends kept."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def _closing(code: str, at: int) -> int:
    """Place after the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _line(code: str, at: int) -> str:
    return f"L{code.count(chr(10), 0, at) + 1}"


_CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")
_GO_FUNC = re.compile(r"(?m)^func\s+(\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\(")
_GO_TYPE = re.compile(r"(?m)^(?:type\s+|\s+)([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{")
_GO_WORDS = frozenset("if for switch select func return go defer range map chan struct interface type var const else case package import".split())
_GO_IMPORT = re.compile(r"(?ms)^import\s+(?:\(([^)]*)\)|([^\n]+))")


def go_rows(source: str) -> list[Row]:
    """Functions, methods, struct and interface types; calls by the enclosing declaration, its own name left out."""
    code = _blanked(_GO_PLAIN, source)
    rows: list[Row] = []
    for m in _GO_TYPE.finditer(code):
        if m.group().startswith("type") or re.search(r"(?m)^type\s*\($", code[: m.start() + 1]):
            rows.append(("symbol", m.group(1), m.group(2), "", _line(code, m.start(1))))
    for m in _GO_FUNC.finditer(code):
        name = m.group(2)
        rows.append(("symbol", name, "method" if m.group(1) else "function", "", _line(code, m.start())))
        start = code.find("{", m.end())
        line_end = code.find("\nfunc ", m.end())
        if start < 0 or 0 <= line_end < start:
            continue
        for c in _CALL.finditer(code, start, _closing(code, start)):
            if c.group(1) not in _GO_WORDS and c.group(1) != name:
                rows.append(("call", name, "calls", c.group(1), _line(code, c.start())))
    for m in _GO_IMPORT.finditer(source):
        for spec in re.findall(r'"([^"]+)"', m.group(1) or m.group(2) or ""):
            rows.append(("import", spec, "go", "", ""))
    return rows


_TS_DECL = re.compile(
    r"(?P<fn>\bfunction\s*\*?\s*(?P<fname>[A-Za-z_$][\w$]*))|(?P<cls>\bclass\s+(?P<cname>[A-Za-z_$][\w$]*))|(?P<itf>\binterface\s+(?P<iname>[A-Za-z_$][\w$]*))"
    r"|(?P<var>\b(?:const|let|var)\s+(?P<vname>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^={]+)?=>|[A-Za-z_$][\w$]*\s*=>))"
)
_TS_METHOD = re.compile(r"(?m)^\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?::[^{;=]+)?\{")
_TS_WORDS = frozenset("if for while switch catch function return typeof new await super import constructor".split())
_TS_ARROW = re.compile(r"=>\s*\{")


def typescript_rows(source: str) -> list[Row]:
    """Functions, classes, interfaces, methods but constructors, named arrow functions; calls of functions and methods."""
    code = _blanked(_TS_PLAIN, source)
    rows: list[Row] = []
    callers: list[tuple[int, int, str]] = []
    for m in _TS_DECL.finditer(code):
        at = m.start()
        if m.group("fn"):
            rows.append(("symbol", m.group("fname"), "function", "", _line(code, at)))
            start = code.find("{", m.end())
            if start >= 0:
                callers.append((start, _closing(code, start), m.group("fname")))
        elif m.group("itf"):
            rows.append(("symbol", m.group("iname"), "interface", "", _line(code, at)))
        elif m.group("var"):
            rows.append(("symbol", m.group("vname"), "function", "", _line(code, at)))
            arrow = code.find("{", m.end() - 1)
            if arrow >= 0 and code[m.end() : arrow].strip() == "":
                callers.append((arrow, _closing(code, arrow), ""))
        else:
            rows.append(("symbol", m.group("cname"), "struct", "", _line(code, at)))
            start = code.find("{", m.end())
            end = _closing(code, start) if start >= 0 else len(code)
            place = start + 1
            while start >= 0 and (d := _TS_METHOD.search(code, place, end)):
                body = d.end() - 1
                stop = _closing(code, body)
                if d.group("name") not in _TS_WORDS:
                    rows.append(("symbol", d.group("name"), "method", "", _line(code, d.start("name"))))
                callers.append((body, stop, "" if d.group("name") == "constructor" else d.group("name")))
                place = stop
    for c in _CALL.finditer(code):
        if c.group(1) in _TS_WORDS or re.search(r"\bnew\s+[\w$.]*$|\bfunction\s*\*?\s*$", code[: c.start()]):
            continue
        around = [x for x in callers if x[0] < c.start() < x[1]]
        if around and (name := max(around)[2]) and c.group(1) != name:
            rows.append(("call", name, "calls", c.group(1), _line(code, c.start())))
    for line in source.splitlines():
        t = line.strip()
        if (" from " in t or t.startswith(("import ", "export "))) and (spec := _quoted(t)):
            rows.append(("import", spec, "relative" if spec.startswith(".") else "package", "", ""))
    return rows


def _quoted(line: str) -> str:
    for quote in "\"'":
        parts = line.split(quote)
        if len(parts) >= 3 and parts[1].strip():
            return parts[1].strip()
    return ""


_READERS = {"py": python_rows, "go": go_rows, "ts": typescript_rows, "tsx": typescript_rows, "js": typescript_rows, "jsx": typescript_rows}


def _join_path(folder: str, rel: str) -> str:
    parts: list[str] = folder.split("/") if folder else []
    for p in rel.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def parsed(files: DataFrame) -> DataFrame:
    """Tagged rows of ``files(path, content)``. A file that does not parse has one row ``error``: its symbols are skipped, not the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                source = (content or b"").decode("utf-8", "replace")
                reader = _READERS.get(path.rsplit(".", 1)[-1].lower())
                try:
                    rows = reader(source) if reader else []
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows = [("error", type(e).__name__, "", "", "")]
                folder = path.rsplit("/", 1)[0] if "/" in path else ""
                for k, (part, name, kind, target, where) in enumerate(rows):
                    out.append((path, part, _join_path(folder, name) if kind == "relative" else name, kind, target, where, k))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            types = [pa.string()] * 6 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["path", "part", "name", "kind", "target", "location", "seq"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, _ROW)


# What is tried for an import, in order.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
ENTRY_FILES = ["src/index.ts", "src/index.tsx", "src/index.js", "src/index.jsx"]


def workspace_packages(files: DataFrame) -> DataFrame:
    """(name, entry): each package.json's first entry file that exists."""
    schema = "name string, `react-native` string, exports map<string, struct<source:string,next:string,types:string>>"
    p = files.where(F.regexp_extract("path", "([^/]*)$", 1) == "package.json").select("path", F.from_json(F.col("content").cast("string"), schema).alias("j"))
    main = F.col("j")["exports"].getItem(".")
    tried = F.array(main["source"], main["next"], main["types"], F.col("j")["react-native"], *map(F.lit, ENTRY_FILES))
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    c = p.where("trim(j.name) <> ''").select(F.col("j.name").alias("name"), folder.alias("folder"), F.posexplode(tried).alias("rank", "file")).where("trim(file) <> ''")
    c = c.withColumn("entry", F.concat("folder", F.regexp_replace(F.trim("file"), r"^\./", "")))
    return c.join(files.select(F.col("path").alias("entry")), "entry", "left_semi").groupBy("name").agg(F.min_by("entry", "rank").alias("entry"))


def imports(files: DataFrame, rows: DataFrame, module: str = "") -> DataFrame:
    """(src_path, dst_path, seq) of static imports between listed files, self imports left out. Equi-joins on candidate paths.

    ``module`` is the Go module's path: an import under it is a folder, which its representative file stands for - named after
    the folder, or index, types or config, else the first by name.
    """
    i = rows.where("part = 'import'").select("path", "name", "kind", "seq").distinct()
    listing = files.select(F.col("path").alias("dst"))
    direct = i.where("kind = 'path'").join(listing, F.col("name") == F.col("dst")).select("path", "dst", "seq")
    tried = i.where("kind = 'relative'").select("path", "name", "seq", F.posexplode(F.array(*map(F.lit, SUFFIXES))).alias("rank", "suffix"))
    tried = tried.withColumn("dst", F.concat("name", "suffix")).join(listing, "dst").groupBy("path", "seq", "name").agg(F.min_by("dst", "rank").alias("dst"))
    packages = i.where("kind = 'package'").join(workspace_packages(files), "name").select("path", F.col("entry").alias("dst"), "seq")
    go = files.where(extension(F.col("path")) == "go").select("path", F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"))
    named = F.col("file").isin("index.go", "types.go", "config.go") | (F.col("file") == F.concat(F.substring_index("folder", "/", -1), F.lit(".go")))
    best = go.groupBy("folder").agg(F.min(F.struct((~named).alias("n"), F.col("file"), F.col("path"))).alias("b")).select("folder", F.col("b.path").alias("dst"))
    # without a module path, folders of these names are taken as they are
    bare = F.lit(module == "") & F.col("name").rlike("^(?:internal|pkg|cmd)/")
    inner = F.when(bare, F.col("name")).when(F.lit(module != "") & (F.col("name") == module), F.lit("")).when(F.lit(module != "") & F.col("name").startswith(module + "/"), F.substr("name", F.lit(len(module) + 2)))
    folders = i.where("kind = 'go'").withColumn("folder", inner).where("folder is not null").join(best, "folder").select("path", "dst", "seq")
    every = direct.unionByName(tried.select("path", "dst", "seq")).unionByName(packages).unionByName(folders)
    return every.where("path <> dst").groupBy(F.col("path").alias("src_path"), F.col("dst").alias("dst_path")).agg(F.min("seq").alias("seq"))


def go_module(files: DataFrame) -> str:
    """The module path of the root's go.mod, empty without one; one small file is read."""
    found = files.where("path = 'go.mod'").select(F.regexp_extract(F.col("content").cast("string"), r"(?m)^[ \t]*module[ \t]+([^\r\n]*)", 1).alias("m")).first()
    return found.m.strip() if found else ""


def extracted(files: DataFrame, repo: str, name: str = "", module: str = "", rows: DataFrame | None = None) -> Graph:
    """Project, file and symbol nodes, ``contains``, ``depends_on`` and ``calls`` edges. Targets of calls are labels.

    ord follows the sorted paths and the place in the file. ``rows``: what ``parsed`` gives for the code files, if that is known.
    """
    order = numbered(files.select("path").distinct(), ["path"], "__n").withColumn("__n", (F.col("__n") + 1) * 1_000_000)
    rows = parsed(files.where(is_code_file(F.col("path")))) if rows is None else rows
    rid = F.lit(repo)
    ext = extension(F.col("path"))
    evidence = F.when(ext == "go", "go_ast").when(ext == "py", "python_ast").otherwise("ts_scan")
    symbols = rows.where("part = 'symbol'").join(order, "path").select(
        F.concat_ws(":", rid, "path", "name").alias("id"), F.col("name").alias("label"), "kind", F.col("path").alias("file"), "location", evidence.alias("evidence_type"), F.lit("extracted").alias("evidence_confidence"), (F.col("__n") + 1 + F.col("seq")).alias("ord")
    )
    file_nodes = order.select(file_node_id(rid, F.col("path")).alias("id"), F.col("path").alias("label"), F.lit("file").alias("kind"), F.col("path").alias("file"), F.lit("").alias("location"), F.lit("filesystem").alias("evidence_type"), F.lit("declared").alias("evidence_confidence"), F.col("__n").alias("ord"))
    spark = files.sparkSession
    project = spark.createDataFrame([(f"project:{repo}", name or repo, "project", "", "", "project", "declared", -1)], file_nodes.schema)
    nodes = project.unionByName(file_nodes).unionByName(symbols).withColumns({"layer": F.lit("repo"), "source_name": F.lit(name or repo), "source_id": rid, "description": F.lit(""), "community": F.lit(0)})

    def edge(df: DataFrame, src, dst, relation: str, confidence: str, file, ord_, projected: str = "") -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(0.0).alias("score"), file.alias("file"), F.lit(projected).alias("projected_from"), ord_.alias("ord"))

    edges = edge(order, project_node_id(rid), file_node_id(rid, F.col("path")), "contains", "", F.lit(""), F.col("__n"))
    edges = edges.unionByName(edge(symbols, file_node_id(rid, F.col("file")), F.col("id"), "contains", "", F.col("file"), F.col("ord")))
    static = imports(files, rows, module).join(order.withColumnRenamed("path", "src_path"), "src_path")
    edges = edges.unionByName(edge(static, file_node_id(rid, F.col("src_path")), file_node_id(rid, F.col("dst_path")), "depends_on", "extracted", F.col("src_path"), F.col("__n") + F.col("seq"), "static_import"))
    calls = rows.where("part = 'call'").join(order, "path")
    edges = edges.unionByName(edge(calls, F.concat_ws(":", rid, "path", "name"), F.col("target"), "calls", "EXTRACTED", F.col("path"), F.col("__n") + F.col("seq")))
    return Graph(nodes, edges)
