"""Identity and evidence as Column expressions (rows I1-I6, I11-I14, R7-R9, R20). Empty and null are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYERS = ("repo", "contract", "workspace", "memory")

# Weight of each confidence and what each verification state adds to it.
CONFIDENCE_WEIGHT = {"declared": 4.0, "extracted": 3.0, "inferred": 2.0, "ambiguous": 1.0}
VERIFICATION_WEIGHT = {"current": 0.30, "redirected": 0.15, "ambiguous": -0.20, "stale": -0.50}

# Fixed value: how the key of an observation starts, whichever way its id is written.
OBSERVATION = "ancora:obs:"

# Id prefixes with the layer and kind that they name.
ID_PREFIXES = [
    ("memory:concept:", "memory", "concept"),
    ("memory:workspace:", "memory", "workspace"),
    ("memory:organization:", "memory", "organization"),
    ("memory:visibility:", "memory", "visibility"),
    ("workspace:repo:", "workspace", "repo"),
    ("workspace:service:", "workspace", "service"),
    ("workspace:package:", "workspace", "package"),
    ("workspace:domain:", "workspace", "domain"),
    ("contract:service:", "contract", "service"),
    ("contract:endpoint:", "contract", "endpoint"),
    ("contract:rpc:", "contract", "rpc"),
    ("project:", "repo", "repo"),
]

_KEY = rf"(?s)^({'|'.join(LAYERS)}):([^:]+):(.+)$"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def parse_canonical_key(raw: Column) -> Column:
    """struct(layer, kind, key), null unless ``raw`` is <layer>:<kind>:<key> of a known layer with no part empty."""
    t = F.trim(text(raw))
    parts = [F.regexp_extract(t, _KEY, i).alias(n) for i, n in ((1, "layer"), (2, "kind"), (3, "key"))]
    return F.when(t.rlike(_KEY), F.struct(*parts))


def _key(layer: str, kind: Column, key: Column) -> Column:
    return F.struct(F.lit(layer).alias("layer"), kind.alias("kind"), key.alias("key"))


def canonical_key_for_id(id_: Column, kind: Column, source_name: Column) -> Column:
    """The first rule that fits: observation alias, canonical form, known prefix, ``:file:``, source name, kind."""
    t, k, s = F.trim(text(id_)), text(kind), text(source_name)
    obs = "memory:observation:"
    rule = F.when(t == "", F.lit(None)).when(t.startswith(obs), _key("memory", F.lit("observation"), F.concat(F.lit(OBSERVATION), F.substr(t, F.lit(len(obs) + 1)))))
    rule = rule.when(parse_canonical_key(t).isNotNull(), parse_canonical_key(t))
    rule = rule.when(t.startswith(OBSERVATION), _key("memory", F.lit("observation"), t))
    for prefix, layer, named in ID_PREFIXES:
        rule = rule.when(t.startswith(prefix), _key(layer, F.lit(named), F.substr(t, F.lit(len(prefix) + 1))))
    at = F.instr(t, ":file:")
    rule = rule.when(at > 1, _key("repo", F.lit("file"), F.concat(F.substr(t, F.lit(1), at - 1), F.lit("/"), F.substr(t, at + len(":file:")))))
    named = F.when(F.trim(k) == "", F.lit("node")).otherwise(F.trim(k))
    rule = rule.when(s != "", _key("repo", named, F.concat(s, F.lit("/"), t)))
    return rule.when(k != "", _key("repo", k, t))


def canonical_key_for_node(id_: Column, kind: Column, source_name: Column, stored: Column) -> Column:
    """A stored canonical key first."""
    return F.coalesce(parse_canonical_key(stored), canonical_key_for_id(id_, kind, source_name))


def canonical_join_key(id_: Column, kind: Column, source_name: Column) -> Column:
    """I4: the canonical form, or the trimmed id."""
    k = canonical_key_for_id(id_, kind, source_name)
    return F.when(k.isNotNull(), F.concat_ws(":", k["layer"], k["kind"], k["key"])).otherwise(F.trim(text(id_)))


def layer_of(source_type: Column) -> Column:
    """I5."""
    return F.when(source_type == "codebase", "repo").when(source_type.isin("memory", "webhook"), "memory").otherwise("")


def node_layer(stored: Column, id_: Column, kind: Column, source_name: Column, source_type: Column) -> Column:
    """The stored layer, the layer of the canonical key, the layer of the source."""
    return F.coalesce(F.nullif(text(stored), F.lit("")), canonical_key_for_id(id_, kind, source_name)["layer"], layer_of(text(source_type)))


def evidence_confidence(stored: Column, confidence: Column) -> Column:
    """The stored evidence confidence, else the edge's own, lowered."""
    return F.when(text(stored) != "", stored).otherwise(F.lower(text(confidence)))


def evidence_weight(confidence: Column, verification: Column, score: Column) -> Column:
    """Confidence, adjusted by verification, plus a hundredth of a positive score."""
    weight = F.lit(0.0)
    for table, of in ((CONFIDENCE_WEIGHT, confidence), (VERIFICATION_WEIGHT, verification)):
        rule = None
        for name, value in table.items():
            rule = (F if rule is None else rule).when(of == name, F.lit(value))
        weight = weight + rule.otherwise(F.lit(0.0))
    return weight + F.when(score > 0, score / 100.0).otherwise(F.lit(0.0))


def stable_fact_key(repo: Column, language: Column, kind: Column, from_: Column, to: Column) -> Column:
    """R20."""
    return F.concat_ws("|", F.trim(text(repo)), F.lower(F.trim(text(language))), text(kind), F.trim(text(from_)), F.trim(text(to)))


def remote_identity(remote: Column) -> Column:
    """struct(id, organization, name) of a git remote: host/org/name for ssh and url forms, else the last path segment.

    The organization is the path before the name.
    """
    t = F.regexp_replace(F.trim(text(remote)), r"\.git$", "")
    ssh = r"^(?:[^@/:]+@)([^:/]+):(.+)$"
    url = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/?#:]+)(?::[0-9]+)?/([^?#]*)"
    host = F.when(t.rlike(ssh), F.regexp_extract(t, ssh, 1)).when(t.rlike(url), F.regexp_extract(t, url, 1)).otherwise("")
    path = F.when(t.rlike(ssh), F.regexp_extract(t, ssh, 2)).when(t.rlike(url), F.regexp_extract(t, url, 2)).otherwise(t)
    path = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"^/|/$", "")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    org = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    full = F.when(host != "", F.concat_ws("/", host, path)).otherwise(name)
    return F.struct(full.alias("id"), F.when(host != "", org).otherwise("").alias("organization"), name.alias("name"))


def source_identity(remote: Column, path: Column, name: Column) -> Column:
    """Identity by remote, else path, else name."""
    return F.when(text(remote) != "", remote_identity(remote)["id"]).when(F.trim(text(path)) != "", F.trim(path)).otherwise(F.trim(text(name)))


def file_node_id(repo: Column, path: Column) -> Column:
    """I13."""
    return F.concat(repo, F.lit(":file:"), path)


def symbol_node_id(repo: Column, path: Column, symbol: Column) -> Column:
    """I13."""
    return F.concat_ws(":", repo, path, symbol)


def project_node_id(repo: Column) -> Column:
    return F.concat(F.lit("project:"), repo)


def workspace_node_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"workspace:{kind}:"), F.lower(F.trim(name)))


def label_of_id(id_: Column) -> Column:
    """What follows the last ``:`` if anything does, else the last path segment, else the id."""
    t = F.trim(text(id_))
    return F.when(t.rlike(r"(?s):[^:]+$"), F.regexp_extract(t, r"(?s)([^:]+)$", 1)).when(t.rlike(r"(?s)/[^/]+$"), F.regexp_extract(t, r"(?s)([^/]+)$", 1)).otherwise(t)
