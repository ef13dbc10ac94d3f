"""A rule-matching engine as joins: rules x requests -> one decision a request.

Rules are documents (dicts): id, enabled, priority, phase, action (block, log,
score), score, blockStatus, shadow, activation and match, whose groups (ip,
path.exact, path.prefix, path.regex, headers, query, method) must all hold.
`plan_rules` sorts rules into usable, deferred and invalid ones and turns the
usable ones into a table of conditions, one row each. Each rule has an anchor,
its most selective group, and every row of it one or more keys: IPv4 ranges
their /16 or /8 buckets, IPv6 and path prefixes, exact paths, methods and values
that must be equal themselves, other values their names, and regexes one key
behind a gate of all patterns at once. A request has the keys that could meet
them, and one join on the key gives candidates, which are then held against all
their conditions. Requests are read once and are not shuffled while the rules
are few enough to go to every task; only ids of what holds are.

Of equal priorities the rule found first comes first: by IPv4 range (the last
to start, then to end, first), IPv6 address and prefix, exact path, path prefix
(the shortest first), path regex, header (names in the order in which rules
name them), query parameter and method, and within these in the order of rules.
"""

from __future__ import annotations

import ipaddress
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.running import running

# Fixed values of rule documents.
ACTIONS = ["block", "log", "score", "challenge", "serve", "drop"]
PHASES = ["request", "response", "connection"]
DEFERRED_ACTIONS = ["challenge", "serve", "drop"]
DEFERRED_MATCHES = ["ja4", "ja4h", "model", "agent"]
STRING_OPS = ["exists", "equals", "contains", "prefix", "regex"]
BLOCK_STATUS, THRESHOLD = 403, 10.0

CONDITIONS = "rule int, grp int, anchor boolean, kind string, name string, op string, value string, low long, high long, probe long, keys array<string>"
#: Up to this many conditions go to every task.
FEW = 100_000
RULES = "rule int, rule_id string, action string, priority double, score double, status int, shadow boolean, groups int"


def _range4(cidr: str) -> tuple[int, int] | None:
    address, _, bits = cidr.partition("/")
    address = address.removeprefix("::ffff:")
    if not re.fullmatch(S.IPV4[1:-1], address) or (("/" in cidr) and not bits.isdigit()) or int(bits or 32) > 32:
        return None
    number = reduce(lambda a, b: a * 256 + int(b), address.split("."), 0)
    size = 1 << (32 - int(bits or 32))
    return number - number % size, number - number % size + size - 1


def _range6(cidr: str) -> str | None:
    address, _, bits = cidr.partition("/")
    if ("/" in cidr and not bits.isdigit()) or int(bits or 128) > 128:
        return None
    try:
        return f"{int(ipaddress.IPv6Address(address.partition('%')[0])):0128b}"[: int(bits or 128)]
    except ValueError:
        return None


def problems(rule: dict) -> list[str]:
    """What is wrong with a rule; an empty list if nothing is."""
    out = []
    finite = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    if rule.get("id") in (None, ""):
        out.append("id is required")
    if rule.get("action") not in ACTIONS:
        out.append("action is unknown")
    if rule.get("phase", "request") not in PHASES:
        out.append("phase is unknown")
    for k in ("priority", "score", "blockStatus"):
        if rule.get(k) is not None and not finite(rule[k]):
            out.append(f"{k} must be a finite number")
    if rule.get("action") == "score" and not finite(rule.get("score")):
        out.append("a score rule needs a score")
    if finite(rule.get("blockStatus")) and not 400 <= rule["blockStatus"] <= 599:
        out.append("blockStatus must be from 400 to 599")
    for k, v in (rule.get("activation") or {}).items():
        if not isinstance(v, list) or not v:
            out.append(f"activation.{k} must not be empty")
    match = rule.get("match")
    if not isinstance(match, dict) or not match:
        return [*out, "match needs a condition"]
    texts = lambda v: isinstance(v, list) and v and all(isinstance(x, str) and x for x in v)
    for k in ("ip", "method"):
        if k in match and not texts(match[k]):
            out.append(f"{k} must be texts")
    out += [f"ip {c} can't be read" for c in match.get("ip", []) if isinstance(c, str) and _range4(c) is None and _range6(c) is None]
    path = match.get("path", {})
    if "path" in match and (not isinstance(path, dict) or not path or not all(isinstance(v, str) and v for v in path.values())):
        out.append("path needs texts")
    elif isinstance(path.get("regex"), str) and S.unsafe_regex(path["regex"]):
        out.append("path.regex can't be used")
    for side in ("headers", "query"):
        for c in match.get(side, []):
            if not isinstance(c, dict) or not c.get("name") or c.get("op") not in STRING_OPS or (c["op"] != "exists" and not isinstance(c.get("value"), str)):
                out.append(f"{side} needs name, op and value")
            elif c["op"] == "regex" and S.unsafe_regex(c["value"]):
                out.append(f"{side} regex can't be used")
    return out


def armed(rule: dict, node: dict) -> bool:
    """Whether a rule's selectors, those it has, all name this node."""
    a = rule.get("activation") or {}
    return ("nodes" not in a or node.get("name") in a["nodes"]) and ("regions" not in a or node.get("region") in a["regions"]) and ("tags" not in a or bool(set(a["tags"]) & set(node.get("tags") or [])))


def classify(rules: list[dict], node: dict | None = None, mode: str = "enforce") -> dict[str, list]:
    """usable, deferred and invalid rules; disabled ones, other phases and those not armed here are in none.

    Mode off classifies without regard to the node; a rule that is disabled is never invalid.
    """
    out: dict[str, list] = {"usable": [], "deferred": [], "invalid": []}
    for rule in rules:
        if rule.get("enabled") is False or (rule.get("phase", "request") != "request" and rule.get("phase") in PHASES):
            continue
        if wrong := problems(rule):
            out["invalid"].append((rule.get("id"), wrong))
        elif rule["action"] in DEFERRED_ACTIONS or rule.get("rateLimit") or set(DEFERRED_MATCHES) & set(rule["match"]):
            out["deferred"].append(rule["id"])
        elif mode == "off" or armed(rule, node or {}):
            out["usable"].append(rule)
    return out


def _groups(match: dict) -> list[list[tuple]]:
    """Condition groups, the most selective first: (kind, name, op, value, low, high); any row of a group will do."""
    out: list[list[tuple]] = []
    if match.get("ip"):
        out.append([("ip4", None, None, None, *r) if (r := _range4(c)) else ("ip6", None, None, _range6(c), None, None) for c in match["ip"]])
    out += [[(k, None, None, match["path"][k], None, None)] for k in ("exact", "prefix", "regex") if k in match.get("path", {})]
    out += [[("header", c["name"].lower(), c["op"], c.get("value"), None, None)] for c in match.get("headers", [])]
    out += [[("query", c["name"], c["op"], c.get("value"), None, None)] for c in match.get("query", [])]
    if match.get("method"):
        out.append([("method", None, None, m.upper(), None, None) for m in match["method"]])
    return out


def _probes(anchors: list[tuple[int, tuple]]) -> list[int]:
    """When each anchor row (rule, condition) is probed."""
    ranges = sorted((k for k, (_, c) in enumerate(anchors) if c[0] == "ip4"), key=lambda k: (anchors[k][1][4], anchors[k][1][5]))
    place = {k: -i for i, k in enumerate(ranges)}
    names = list(dict.fromkeys(c[1] for _, c in anchors if c[0] == "header"))
    out = []
    for k, (rule, (kind, name, _, value, _, _)) in enumerate(anchors):
        turn = {"ip4": 0, "ip6": 1 if len(value or "") == 128 else 2, "exact": 3, "prefix": 4, "regex": 5, "header": 6, "query": 7, "method": 8}[kind]
        first = {"ip4": (1 << 20) + place.get(k, 0), "prefix": len(value or ""), "header": names.index(name) if kind == "header" else 0}.get(kind, 0)
        out.append((turn << 50) + (first << 25) + rule)
    return out


def _keys(kind: str, name: str | None, op: str | None, value: str | None, low: int | None, high: int | None) -> list[str]:
    """The keys of an anchor row; a request that it holds for has at least one of them."""
    if kind == "ip4":
        shift = 16 if (high >> 16) - (low >> 16) < 256 else 24
        return [f"ip{shift}:{n}" for n in range(low >> shift, (high >> shift) + 1)]
    if kind in ("header", "query"):
        return [f"{kind}={name}={value}" if op == "equals" else f"{kind}:{name}"]
    return [kind] if kind == "regex" else [f"{kind}:{value}"]


def plan_rules(spark: SparkSession, usable: list[dict], mode: str = "enforce") -> tuple[DataFrame, DataFrame]:
    """(rules, conditions) of usable rules, which `matches` and `decide` take."""
    heads, conditions, anchors = [], [], []
    for i, r in enumerate(usable):
        groups = _groups(r["match"])
        heads.append((i, str(r["id"]), r["action"], float(r.get("priority") or 0), float(r.get("score") or 0), int(r.get("blockStatus") or BLOCK_STATUS), bool(r.get("shadow")) or mode == "monitor", len(groups)))
        anchors += [(i, c) for c in groups[0]]
        conditions += [(i, g, False, *c, None, None) for g, group in enumerate(groups) if g for c in group]
    conditions += [(i, 0, True, *c, probe, _keys(*c)) for (i, c), probe in zip(anchors, _probes(anchors), strict=True)]
    return spark.createDataFrame(heads, RULES), spark.createDataFrame(conditions, CONDITIONS)


def prepared(requests: DataFrame) -> DataFrame:
    """Requests (req, ip, method, path, query, headers map<string, array<string>>) in the form rules are held against."""
    entries = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,array<string>>"))), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("values")))
    ip = S.normal_ip(F.col("ip"))
    return requests.select("req", S.ipv4_number(ip).alias("ip4"), S.ipv6_bits(ip).alias("ip6"), S.canonical_path(F.col("path")).alias("path"), F.upper("method").alias("method"), S.parse_query(F.col("query")).alias("query"), entries.alias("headers"))


def interval_join(left: DataFrame, number: str, ranges: DataFrame, wide: int = 256) -> DataFrame:
    """Rows of `left` with each range (low, high) of 32-bit numbers that holds their number.

    Ranges are cut at multiples of 65,536 and joined by that bucket; those of
    `wide` buckets and more at multiples of 2^24, of which there are 256.
    """
    known, span = left.where(F.col(number).isNotNull()), F.shiftright("high", 16) - F.shiftright("low", 16)
    found = []
    for some, bits in ((ranges.where(span < wide), 16), (ranges.where(span >= wide), 24)):
        cut = some.withColumn("_bucket", F.explode(F.sequence(F.shiftright("low", bits), F.shiftright("high", bits))))
        found.append(known.withColumn("_bucket", F.shiftright(number, bits)).join(cut, "_bucket").where(F.col(number).between(F.col("low"), F.col("high"))).drop("_bucket"))
    return found[0].unionByName(found[1])


def prefix_max_ends(ranges: DataFrame) -> DataFrame:
    """Ranges (low, high) with the highest end up to each, in order of low, then high; ranges of equal bounds are one another's peers.

    A number is in no range before one whose `most` it exceeds.
    """
    return running(ranges, [], ["low", "high"], {"most": ("max", "high")})


def prefix_join(left: DataFrame, text: str, prefixes: DataFrame, prefix: str, lengths: list[int]) -> DataFrame:
    """Rows of `left` with each prefix of their text, by equality on prefixes of the lengths that occur."""
    if not lengths:
        return left.join(prefixes, F.lit(False))
    spread = left.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.length(text) >= F.col("_n"))
    return spread.withColumn("_head", F.substring(F.col(text), F.lit(1), F.col("_n"))).join(prefixes.withColumnRenamed(prefix, "_head"), "_head").drop("_n", "_head")


def facts(conditions: DataFrame) -> dict:
    """What the rules' own table holds: prefix lengths and patterns of its anchors, and whether it is small."""
    kinds = conditions.groupBy("anchor", "kind", F.length("value").alias("n"), F.when(F.col("kind") == "regex", F.col("value")).alias("pattern")).agg(F.count(F.lit(1)).alias("rows")).collect()
    lengths = {k: sorted({r.n for r in kinds if r.anchor and r.kind == k}) for k in ("ip6", "prefix")}
    return {"lengths": lengths, "patterns": sorted({r.pattern for r in kinds if r.anchor and r.kind == "regex"}), "few": sum(r.rows for r in kinds) <= FEW}


def candidates(requests: DataFrame, conditions: DataFrame, plan: dict | None = None) -> DataFrame:
    """(request columns, rule): pairs whose anchor holds, or may hold where its operation isn't equality; not distinct.

    Goes through the requests once.
    """
    plan = plan or facts(conditions)
    lengths, patterns = plan["lengths"], plan["patterns"]
    none = F.array().cast("array<string>")

    def heads(kind: str, text: str) -> Column:
        every = [F.when(F.length(text) >= n, F.concat(F.lit(f"{kind}:"), F.substring(text, 1, n))) for n in sorted(lengths[kind])]
        return F.array(*every) if every else none

    def named(kind: str, entries: str, values) -> list[Column]:
        by_name = F.transform(entries, lambda x: F.concat(F.lit(f"{kind}:"), x["name"]))
        return [by_name, F.flatten(F.transform(entries, lambda x: F.transform(values(x), lambda v: F.concat(F.lit(f"{kind}="), x["name"], F.lit("="), v))))]

    gate = F.array(F.when(F.col("path").rlike("|".join(f"(?:{p})" for p in patterns)), "regex")) if patterns else none
    keys = [
        F.array(F.concat(F.lit("ip16:"), F.shiftright("ip4", 16)), F.concat(F.lit("ip24:"), F.shiftright("ip4", 24)), F.concat(F.lit("exact:"), "path"), F.concat(F.lit("method:"), "method")),
        heads("ip6", "ip6"), heads("prefix", "path"), gate,
        *named("header", "headers", lambda h: h["values"]), *named("query", "query", lambda q: F.array(q["value"])),
    ]
    spread = requests.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(k, none) for k in keys])))))
    listed = conditions.where("anchor").select("rule", F.explode("keys").alias("_key")).distinct()
    return spread.join(_small(listed, plan), "_key").drop("_key")


def _small(rules: DataFrame, plan: dict) -> DataFrame:
    """Broadcast if the rules have few conditions."""
    return F.broadcast(rules) if plan["few"] else rules


def _holds() -> Column:
    """Whether a condition holds for a request; both are columns of one row."""
    value = F.col("value")

    def test(v: Column) -> Column:
        return F.when(F.col("op") == "exists", F.lit(True)).when(F.col("op") == "equals", v == value).when(F.col("op") == "contains", v.contains(value)).when(F.col("op") == "prefix", v.startswith(value)).when(F.col("op") == "regex", F.regexp_like(v, value))

    header = F.exists(F.filter("headers", lambda h: h["name"] == F.col("name")), lambda h: F.exists(h["values"], test))
    query = F.exists(F.filter("query", lambda q: q["name"] == F.col("name")), lambda q: test(q["value"]))
    kind = F.col("kind")
    found = (
        F.when(kind == "ip4", F.col("ip4").between(F.col("low"), F.col("high")))
        .when(kind == "ip6", F.col("ip6").startswith(value))
        .when(kind == "exact", F.col("path") == value)
        .when(kind == "prefix", F.col("path").startswith(value))
        .when(kind == "regex", F.regexp_like("path", value))
        .when(kind == "header", header)
        .when(kind == "query", query)
        .when(kind == "method", F.col("method") == value)
    )
    return F.coalesce(found, F.lit(False))


def matches(requests: DataFrame, rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """(req, rule columns, probe) of every rule all of whose groups hold; probe settles equal priorities."""
    plan = facts(conditions)
    pairs = candidates(prepared(requests), conditions, plan)
    held = pairs.join(_small(conditions.select("rule", "grp", "kind", "name", "op", "value", "low", "high", "probe"), plan), "rule").where(_holds()).select("req", "rule", "grp", "probe")
    whole = held.groupBy("req", "rule").agg(F.size(F.collect_set("grp")).alias("_held"), F.min("probe").alias("probe"))
    return whole.join(_small(rules, plan), "rule").where(F.col("_held") == F.col("groups")).drop("_held", "groups")


def statistics(matched: DataFrame, time: str | None = None) -> DataFrame:
    """(rule_id, hit_count, last_matched) of all matches, whatever was decided."""
    last = F.max(time) if time else F.lit(None).cast("timestamp")
    return matched.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hit_count"), last.alias("last_matched"))


def _track(shadow: bool, threshold: float) -> Column:
    """The fold over matched rules in order of priority: the first block rule, or score rules up to the threshold, decides."""
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<string>").alias("ids"), F.lit(False).alias("done"), F.lit(0).alias("status"), F.lit(False).alias("scored"))

    def step(s, r):
        mine = (r["action"] != "log") & (r["shadow"] == F.lit(shadow)) & ~s["done"]
        total = s["total"] + r["score"]
        block = F.struct(s["total"].alias("total"), F.array(r["rule_id"]).alias("ids"), F.lit(True).alias("done"), r["status"].alias("status"), F.lit(False).alias("scored"))
        over = total >= threshold
        score = F.struct(total.alias("total"), F.concat(s["ids"], F.array(r["rule_id"])).alias("ids"), over.alias("done"), F.when(over, BLOCK_STATUS).otherwise(0).alias("status"), over.alias("scored"))
        return F.when(~mine, s).when(r["action"] == "block", block).otherwise(score)

    return F.aggregate("_m", start, step)


def decide(matched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(req, action, status, rule_ids, score, log_rule_ids, shadow_rule_ids) of each request that gets a decision.

    A request has at most as many matches as there are rules, so they are
    folded as one array.
    """
    ordered = matched.groupBy("req").agg(F.array_sort(F.collect_list(F.struct("priority", "probe", "rule", "rule_id", "action", "score", "status", "shadow"))).alias("_m"))
    logs = F.transform(F.filter("_m", lambda r: r["action"] == "log"), lambda r: r["rule_id"])
    both = ordered.select("req", logs.alias("_logs"), _track(False, threshold).alias("_r"), _track(True, threshold).alias("_s"))
    blocked, shadowed, logged = F.col("_r.done"), F.col("_s.done"), F.size("_logs") > 0
    some = lambda a, ok: F.when(ok, a)
    rest = F.when(F.col("_r.total") > 0, F.col("_r.total"))
    return both.where(blocked | shadowed | logged).select(
        "req", F.when(blocked, "block").otherwise("log").alias("action"), F.when(blocked, F.col("_r.status")).otherwise(0).alias("status"), F.when(blocked, F.col("_r.ids")).otherwise(F.col("_logs")).alias("rule_ids"),
        F.when(blocked, F.when(F.col("_r.scored"), F.col("_r.total"))).otherwise(rest).alias("score"), some(F.col("_logs"), blocked & logged).alias("log_rule_ids"), some(F.col("_s.ids"), shadowed).alias("shadow_rule_ids"),
    )


def evaluate(requests: DataFrame, rules: list[dict], node: dict | None = None, mode: str = "enforce", threshold: float = THRESHOLD, control: dict | None = None) -> DataFrame:
    """Decisions for requests. A control row overrides mode and threshold; an unusable threshold is ignored."""
    control = control or {}
    mode = control.get("mode", mode)
    wanted = control.get("scoreThreshold")
    threshold = float(wanted) if isinstance(wanted, (int, float)) and not isinstance(wanted, bool) and math.isfinite(wanted) and wanted > 0 else threshold
    usable = [] if mode == "off" else classify(rules, node, mode)["usable"]
    heads, conditions = plan_rules(requests.sparkSession, usable, mode)
    return decide(matches(requests, heads, conditions), threshold)


def problems_of(rules: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds problems: the names of the checks that a record fails; a check that gives null fails."""
    return rules.withColumn("problems", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))


CONTROL, MODES = "control", ["enforce", "monitor", "off"]


def with_control(rows: DataFrame, mode: str | None = None, threshold: float | None = None) -> DataFrame:
    """Rows (id, mode, scoreThreshold) with the control row set; what isn't given stays as it is, and there is one such row."""
    usable = isinstance(threshold, (int, float)) and not isinstance(threshold, bool) and math.isfinite(threshold) and threshold > 0
    if (mode is None and threshold is None) or (mode is not None and mode not in MODES) or (threshold is not None and not usable):
        raise ValueError("mode must be one of enforce, monitor, off, and scoreThreshold a finite positive number")
    of = lambda c, value, kind: F.coalesce(F.lit(value).cast(kind), F.max(F.when(F.col("id") == CONTROL, F.col(c)))).alias(c)
    row = rows.agg(of("mode", mode, "string"), of("scoreThreshold", threshold, "double")).select(F.lit(CONTROL).alias("id"), "mode", "scoreThreshold")
    return rows.where(F.coalesce(F.col("id") != CONTROL, F.lit(True))).select("id", "mode", "scoreThreshold").unionByName(row)
