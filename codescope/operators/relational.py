"""Detectors that are joins, anti-joins and dominance counts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescope.functions.text import any_of, contains_ci, ends_with_any, file_stem, simple_type_name
from codescope.session import cut_lineage, in_bounded_tasks, lookup_side, shuffled, written
from codescope.sources.files import is_generated

# Name endings of injected services.
SERVICE_SUFFIXES = ["Service", "Repository", "Manager", "Factory", "Provider", "Handler", "Validator", "Dispatcher"]
# Collection interfaces a container resolves by itself.
NATIVE_COLLECTIONS = ["IEnumerable", "IReadOnlyList", "IReadOnlyCollection", "ICollection", "IList", "ISet", "IQueryable"]
# Types that frameworks register; a name starting with one is skipped.
FRAMEWORK_TYPES = [
    "ILogger", "ILoggerFactory", "ILoggerProvider", "IOptions", "IOptionsMonitor", "IOptionsSnapshot",
    "IOptionsFactory", "IConfiguration", "IConfigurationRoot", "IConfigurationSection", "IHostEnvironment",
    "IWebHostEnvironment", "IHostApplicationLifetime", "IHostLifetime", "IApplicationLifetime",
    "IServiceProvider", "IServiceScopeFactory", "IServiceScope", "IHttpClientFactory", "IMemoryCache",
    "IDistributedCache", "IHybridCache", "IHttpContextAccessor", "IHttpContextFactory",
    "IActionContextAccessor", "ProblemDetailsFactory", "IConnection", "IConnectionMultiplexer",
    "IFeatureManager", "IVariantFeatureManager", "IJSRuntime", "IJSInProcessRuntime", "NavigationManager",
    "AuthenticationStateProvider", "IComponentActivator", "IHubContext", "IHubClients", "IStringLocalizer",
    "IStringLocalizerFactory", "IHtmlLocalizer", "IHtmlLocalizerFactory", "IAuthorizationService",
    "IAuthorizationPolicyProvider", "IDataProtectionProvider", "IDataProtector", "ILocalStorageService",
    "ISessionStorageService", "IMapper", "IMediator", "ISender", "IPublisher", "IBus", "IPublishEndpoint",
    "ISendEndpointProvider", "ITopicProducer", "IRequestClient", "IEventHubProducerClient", "IQueueClient",
    "ITopicClient", "IMessageBus", "IOutboxWriter", "IOutboxReader", "IEventPublisher",
    "IDomainEventPublisher",
]
# Namespace segments that name a layer.
LAYERS = [
    "Controllers", "Endpoints", "Hubs", "Workers", "Services", "Managers", "Handlers", "Queries", "Commands",
    "Domain", "Models", "Entities", "Data", "Repositories", "Migrations",
]
# Layers that a layer must not import.
FORBIDDEN_LAYERS = {
    "Controllers": ["Data", "Repositories", "Migrations"],
    "Endpoints": ["Data", "Repositories", "Migrations"],
    "Hubs": ["Data", "Repositories", "Migrations"],
    "Workers": ["Repositories", "Migrations"],
    "Services": ["Migrations"],
    "Managers": ["Migrations"],
    "Domain": ["Data", "Repositories", "Migrations"],
    "Models": ["Data", "Repositories", "Migrations"],
    "Entities": ["Data", "Repositories", "Migrations"],
}
# Endings of classes that carry data.
DATA_CARRIER_SUFFIXES = [
    "Request", "Response", "Dto", "ViewModel", "Model", "Options", "Settings", "Config", "Configuration",
    "Entity", "Projection", "Args", "Arguments", "Event", "Command", "Query", "Message", "Payload",
]
# Collection types that grow without bound, and the calls that grow them.
GROWING_TYPES = [
    "Dictionary", "List", "HashSet", "SortedDictionary", "SortedSet", "ConcurrentDictionary", "ConcurrentBag",
    "ConcurrentQueue", "Queue", "Stack", "LinkedList",
]
GROWING_CALLS = ["Add", "TryAdd", "TryGetOrAdd", "Enqueue", "Push"]


def keys_of(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct keys of the tested side of a semi or anti join. A key with a large share
    of the rows collapses on the map side; the join then reuses the same partitioning."""
    return df.select(*columns).distinct()


def _without(wanted: DataFrame, used: DataFrame, n_symbols: int) -> DataFrame:
    """The definitions ``wanted``, of ``n_symbols`` in all, whose symbol is not in ``used``. Wide
    rows and all their symbols are sorted by the join, in tasks of bounded size."""
    dealt = in_bounded_tasks(wanted, n_symbols, "symbol_id")
    return dealt.join(keys_of(used, "symbol_id"), "symbol_id", "left_anti")


def unused_definitions(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Private methods, properties and fields without a reference; constructors without one
    in classes having several; locals that are never read."""
    kind, n = F.col("kind"), definitions.count()
    private = kind.isin("method", "property", "field") & (F.col("accessibility") == "private")
    several = (
        definitions.where(kind == "constructor")
        .groupBy("container")
        .agg(F.count("*").alias("_n"))
        .where("_n > 1")
    )
    # References leave few definitions; only those are moved to their containers.
    candidates = definitions.where(private | (kind == "constructor"))
    unreferenced = (
        _without(candidates, references, n)
        .join(several, "container", "left")
        .where((kind != "constructor") | F.col("_n").isNotNull())
        .select(*definitions.columns)
    )
    reads = references.where(F.col("ref_kind").isin("read", "capture", "return"))
    unread = _without(definitions.where(kind == "local"), reads, n)
    return unreferenced.unionByName(unread)


def uninstantiated_types(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Types that are created nowhere."""
    creations = references.where(F.col("ref_kind") == "create")
    return _without(definitions.where(F.col("kind") == "type"), creations, definitions.count())


def unimplemented_interfaces(definitions: DataFrame, implementations: DataFrame) -> DataFrame:
    """Interfaces no type implements; ``implementations`` runs from type (src) to interface (dst)."""
    used = implementations.select(F.col("dst").alias("name"))
    return definitions.where(F.col("kind") == "interface").join(keys_of(used, "name"), "name", "left_anti")


def unused_dependencies(packages: DataFrame, usages: DataFrame) -> DataFrame:
    """Declared packages that no source line of the project uses."""
    return packages.join(keys_of(usages, "project", "package"), ["project", "package"], "left_anti")


def looks_injected(type_name: Column) -> Column:
    simple = simple_type_name(type_name)
    native = F.lower(simple).isin([n.lower() for n in NATIVE_COLLECTIONS])
    return ~native & (simple.rlike(r"^I\p{Lu}") | ends_with_any(simple, SERVICE_SUFFIXES))


def framework_provided(type_name: Column) -> Column:
    return simple_type_name(type_name).rlike("(?i)^(?:" + "|".join(FRAMEWORK_TYPES) + ")")


# Parts of a path that mark test projects.
TEST_PROJECT_PATHS = r"\.Tests\.|Tests/|Tests\\"


def unregistered_services(constructor_params: DataFrame, registrations: DataFrame) -> DataFrame:
    """Injected types (``consumer, type, path``) that are registered neither as a service nor
    as an implementation (``service, implementation``)."""
    injected = (
        constructor_params.where(looks_injected(F.col("type")) & ~framework_provided(F.col("type")))
        .where(~F.col("path").rlike(TEST_PROJECT_PATHS))
        .withColumn("_key", F.lower(simple_type_name(F.col("type"))))
    )
    names = [
        registrations.select(F.lower(simple_type_name(F.col(c))).alias("_key"))
        for c in ("service", "implementation")
    ]
    return injected.join(names[0].union(names[1]).distinct(), "_key", "left_anti").drop("_key")


def captive_dependencies(constructor_params: DataFrame, registrations: DataFrame) -> DataFrame:
    """Singletons holding a shorter-lived type. The first registration of a name wins;
    ``ord`` is its position."""
    first = (
        registrations.groupBy("service")
        .agg(F.min_by("lifetime", "ord").alias("lifetime"))
    )
    singletons = first.where(F.col("lifetime") == "Singleton").select(F.col("service").alias("consumer"))
    shorter = first.where(F.col("lifetime").isin("Scoped", "Transient")).select(
        F.col("service").alias("dependency"), F.col("lifetime").alias("dependency_lifetime")
    )
    return constructor_params.join(singletons, "consumer", "left_semi").join(shorter, "dependency")


def obsolete_callers(
    definitions: DataFrame, references: DataFrame, message_pattern: str | None = None
) -> DataFrame:
    """Call sites of members marked obsolete, the declaration's own line left out."""
    marked = definitions.where(F.col("obsolete_message").isNotNull())
    if message_pattern is not None:
        marked = marked.where(contains_ci(F.col("obsolete_message"), message_pattern))
    targets = marked.select(
        "symbol_id",
        F.col("name").alias("obsolete_name"),
        "obsolete_message",
        F.col("path").alias("_dp"),
        F.col("line").alias("_dl"),
    )
    calls = references.join(targets, "symbol_id")
    return calls.where(~((F.col("path") == F.col("_dp")) & (F.col("line") == F.col("_dl")))).drop("_dp", "_dl")


def layer_of(namespace: Column, layers: Sequence[str] = tuple(LAYERS)) -> Column:
    """The first dotted segment that names a layer, in lower case, or null."""
    names = "|".join(re.escape(layer.lower()) for layer in layers)
    return F.nullif(F.regexp_extract(F.lower(namespace), rf"(?:^|\.)({names})(?=\.|$)", 1), F.lit(""))


def layer_violations(
    imports: DataFrame,
    layers: Sequence[str] = tuple(LAYERS),
    forbidden: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Imports (``namespace, imported, path, line``) of a layer forbidden to the file's own.

    The rules are a fixed handful, so they are a membership test and not a join.
    """
    rules = FORBIDDEN_LAYERS if forbidden is None else forbidden
    pairs = [f"{a.lower()}>{b.lower()}" for a, targets in rules.items() for b in targets]
    own, other = layer_of(F.col("namespace"), layers), layer_of(F.col("imported"), layers)
    # Most imports name no forbidden layer: a substring test spares them the regexes.
    targets = sorted({b for forbidden_here in rules.values() for b in forbidden_here})
    return (
        imports.where(any_of([contains_ci(F.col("imported"), b) for b in targets]))
        .withColumns({"source_layer": own, "target_layer": other})
        .where(F.concat(F.col("source_layer"), F.lit(">"), F.col("target_layer")).isin(pairs))
    )


def version_conflicts(packages: DataFrame) -> DataFrame:
    """Packages used in several versions: a row per project and version."""
    uses = packages.select("package", "project", "version").distinct()
    conflicting = (
        uses.groupBy("package")
        .agg(F.count_distinct("version").alias("n_versions"))
        .where("n_versions > 1")
    )
    return uses.join(conflicting, "package")


def _dominant(counts: DataFrame, value: str) -> DataFrame:
    """(value, n, n_values, n_entities) of the most frequent value as a scalar struct; equal
    counts go to the least value."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("value")))
    row = F.struct(
        best["value"].alias("value"), (-best["n"]).alias("n"), F.count("*").alias("n_values"), F.sum("n").alias("n_entities")
    )
    return counts.agg(row.alias("top")).scalar()


def dominant_value_outliers(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Entities whose value is not the most common one. Silent with fewer than two entities
    or a single value."""
    rows = df.select(F.col(entity).alias("entity"), F.col(value).alias("value")).where(F.col("value").isNotNull())
    top = _dominant(rows.groupBy("value").agg(F.count("*").alias("n")), "value")
    return (
        rows.withColumn("_top", top)
        .where((F.col("_top.n_entities") >= 2) & (F.col("_top.n_values") > 1) & (F.col("value") != F.col("_top.value")))
        .select("entity", "value", F.col("_top.value").alias("dominant_value"), F.col("_top.n").alias("dominant_count"))
    )


def naming_prefix_outliers(projects: DataFrame, separator: str = r"\.") -> DataFrame:
    """Projects not starting with the most common first segment, if at least two and a
    quarter of all projects share it."""
    names = cut_lineage(projects.select("project").distinct())
    prefix = F.split("project", separator)[0]
    counts = names.where(prefix != "").groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    top = _dominant(counts, "prefix")
    total = names.agg(F.count("*").alias("n")).scalar()
    return (
        names.withColumn("_top", top)
        .select("project", F.col("_top.value").alias("dominant_prefix"), F.col("_top.n").alias("prefix_count"), total.alias("_total"))
        .where(F.col("prefix_count") >= F.greatest(F.lit(2), F.expr("_total div 4")))
        .where(~F.startswith("project", "dominant_prefix"))
        .drop("_total")
    )


def missing_cases(switches: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Enum members a switch without default does not handle, a row each.

    ``switches``: (switch_id, enum_type, has_default); ``members``: (enum_type, member);
    ``labels``: (switch_id, label). Complete switches are dropped by count before any
    switch meets the members of its enum.
    """
    # Written, so that the switches of one enum can be split over tasks in the join.
    sizes = cut_lineage(members.groupBy("enum_type").agg(F.count_distinct("member").alias("n_members")))
    open_switches = switches.where(~F.col("has_default")).select("switch_id", "enum_type")
    used = labels.select("switch_id", F.col("label").alias("member")).distinct()
    handled = (
        used.join(open_switches, "switch_id")
        .join(members.select("enum_type", "member").distinct(), ["enum_type", "member"], "left_semi")
        .groupBy("switch_id")
        .agg(F.count("*").alias("n_handled"))
    )
    incomplete = (
        open_switches.join(sizes, "enum_type")
        .join(handled, "switch_id", "left")
        .na.fill(0, ["n_handled"])
        .where("n_handled < n_members")
    )
    return (
        incomplete.join(members.select("enum_type", "member").distinct(), "enum_type")
        .join(used, ["switch_id", "member"], "left_anti")
        .select("switch_id", "enum_type", "n_members", "n_handled", F.col("member").alias("missing"))
    )


def _pieces(column: Column, size: int) -> Column:
    """All distinct pieces of ``size`` letters. One pass: ``substr`` would walk the text from its
    start for each of them."""
    every = F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def names_containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, name) for each name that contains the part; both are distinct and lower case.

    Exact without comparing every pair: a part is looked for by its rarest piece of the longest
    power of two letters it holds, at least half of it, and the match itself is then tested.
    Names send on only pieces that some part asks for. Neither side is ever broadcast by an
    estimate: the pieces are many times the names they come from, which Spark does not foresee.
    """
    tier = F.floor(F.log2(F.char_length("part") + F.lit(0.5))).cast("int")
    sizes = [1 << r["t"] for r in parts.where("part <> ''").select(tier.alias("t")).distinct().collect()]
    if not sizes:
        return parts.crossJoin(names).select("part", "name").limit(0)
    asked = reduce(
        DataFrame.unionByName,
        [parts.where(tier == size.bit_length() - 1).select("part", F.explode(_pieces(F.col("part"), size)).alias("gram")) for size in sizes],
    )
    asked = written(asked, "pieces-asked")
    keys = written(asked.select("gram").distinct(), "pieces")
    held = F.concat(*[_pieces(F.col("name"), size) for size in sorted(sizes)])
    # Written once: read for the counts and for the join, which can then split a common piece.
    pieces = names.select("name", F.explode(held).alias("gram"))
    met = written(pieces.join(lookup_side(keys, keys.count()), "gram", "left_semi"), "pieces-met")
    frequency = met.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        asked.join(shuffled(frequency), "gram")
        .groupBy("part")
        .agg(F.min(F.struct("n", "gram")).alias("_g"))
        .select("part", "_g.gram")
    )
    rarest = written(rarest, "rarest")
    return met.join(lookup_side(rarest, rarest.count()), "gram").where(F.contains("name", "part")).select("part", "name")


def test_coverage_map(methods: DataFrame, tests: DataFrame, calls: DataFrame) -> DataFrame:
    """(method, test_id, via): a test covers the methods whose name its own name contains
    (ignoring case), and those it calls. Methods go by lower-case name, so the map grows
    with the tests and not with the number of methods sharing a name. ``calls``: (src test,
    dst method name)."""
    parts = methods.select(F.lower("name").alias("part")).where("part <> ''").distinct()
    lowered = tests.select(F.col("symbol_id").alias("test_id"), F.lower("name").alias("name"))
    by_name = (
        names_containing(lowered.select("name").distinct(), parts)
        .join(shuffled(lowered), "name")
        .select(F.col("part").alias("method"), "test_id", F.lit("name").alias("via"))
    )
    by_call = (
        calls.select(F.col("src").alias("test_id"), F.lower("dst").alias("method"))
        .distinct()
        .join(shuffled(lowered), "test_id")
        .where(~F.contains("name", "method"))
        .join(parts.select(F.col("part").alias("method")), "method", "left_semi")
        .select("method", "test_id", F.lit("call").alias("via"))
    )
    return by_name.unionByName(by_call)


def method_coverage(methods: DataFrame, tests: DataFrame, calls: DataFrame) -> DataFrame:
    """Every method with its number of tests and ``has_tests``.

    Names are matched once per distinct name, and only counts are carried on, so a common
    name does not produce a row for each of its (method, test) pairs.
    """
    parts = methods.select(F.lower("name").alias("part")).where("part <> ''").distinct()
    per_name = cut_lineage(tests.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("_n")))
    matches = names_containing(per_name.select("name"), parts)
    named = matches.join(shuffled(per_name), "name").groupBy("part").agg(F.sum("_n").alias("_by_name"))
    called = (
        calls.select(F.col("src").alias("symbol_id"), F.lower("dst").alias("part"))
        .distinct()
        .join(shuffled(tests.select("symbol_id", F.lower("name").alias("_t"))), "symbol_id")
        .where(~F.contains("_t", "part"))
        .groupBy("part")
        .agg(F.count("*").alias("_by_call"))
    )
    counts = named.join(called, "part", "full").na.fill(0)
    n_tests = F.coalesce(F.col("_by_name") + F.col("_by_call"), F.lit(0).cast("long"))
    return methods.join(shuffled(counts), F.lower("name") == F.col("part"), "left").select(
        "symbol_id", "name", n_tests.alias("n_tests"), (n_tests > 0).alias("has_tests")
    )


def readonly_candidates(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Private instance fields that nothing outside a constructor writes."""
    fixed = F.arrays_overlap("modifiers", F.array(F.lit("readonly"), F.lit("static"), F.lit("const")))
    fields = definitions.where((F.col("kind") == "field") & (F.col("accessibility") == "private") & ~fixed)
    writes = references.where(F.col("ref_kind").isin("write", "ref", "out") & ~F.col("in_constructor"))
    return _without(fields, writes, definitions.count())


def unpaired_subscriptions(references: DataFrame) -> DataFrame:
    """Event subscriptions that the same file never undoes for the same event and handler."""
    key = ["path", "event", "handler"]
    undone = references.where(F.col("ref_kind") == "unsubscribe").select(*key).distinct()
    return references.where(F.col("ref_kind") == "subscribe").join(undone, key, "left_anti")


def missing_token_forwarding(
    definitions: DataFrame, parameters: DataFrame, edges: DataFrame
) -> DataFrame:
    """Async methods without a token parameter that call methods accepting one: a row per
    such callee. Abstract methods and event handlers are skipped."""
    token = parameters.where(F.col("type").rlike(r"(?:^|\.)CancellationToken$")).select("symbol_id").distinct()
    handlers = parameters.where((F.col("ord") == 2) & F.col("type").contains("EventArgs")).select("symbol_id").distinct()
    returns_task = F.col("return_type").rlike("^(?:Value)?Task")
    methods = (
        definitions.where((F.col("kind") == "method") & (F.array_contains("modifiers", "async") | returns_task))
        .where(~F.array_contains("modifiers", "abstract"))
        .join(token, "symbol_id", "left_anti")
        .join(handlers, "symbol_id", "left_anti")
    )
    accepting = token.select(F.col("symbol_id").alias("callee"))
    calls = edges.select(F.col("src").alias("symbol_id"), F.col("dst").alias("callee")).distinct()
    return calls.join(accepting, "callee", "left_semi").join(methods, "symbol_id").select(
        "symbol_id", "name", "container", "callee"
    )


def tokens_not_forwarded(
    definitions: DataFrame, parameters: DataFrame, edges: DataFrame, references: DataFrame
) -> DataFrame:
    """Calls by async methods that have a token parameter to methods that accept one, where the
    text of the call names none of the caller's tokens: a row per call site.

    ``edges``: (src, dst) calls; ``references``: the call sites with caller_id and text.
    """
    is_token = F.col("type").rlike(r"(?:^|\.)CancellationToken$")
    tokens = parameters.where(is_token).select("symbol_id", "name")
    returns_task = F.col("return_type").rlike("^(?:Value)?Task")
    methods = definitions.where((F.col("kind") == "method") & (F.array_contains("modifiers", "async") | returns_task))
    callers = methods.select(F.col("symbol_id").alias("caller_id")).join(tokens.withColumnRenamed("symbol_id", "caller_id"), "caller_id")
    accepting = tokens.select("symbol_id").distinct()
    calls = edges.select(F.col("src").alias("caller_id"), F.col("dst").alias("symbol_id")).distinct()
    sites = references.select("caller_id", "symbol_id", "path", "line", "text").join(calls, ["caller_id", "symbol_id"], "left_semi")
    sites = sites.join(accepting, "symbol_id", "left_semi").join(callers, "caller_id")
    named = F.regexp_like("text", F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\b")))
    return sites.groupBy("caller_id", "symbol_id", "path", "line").agg(F.bool_or(named).alias("_named")).where(~F.col("_named")).drop("_named")


# Collection types that callers can change.
MUTABLE_COLLECTIONS = ["List", "Dictionary", "HashSet", "Queue", "Stack", "IList", "IDictionary", "ISet", "ICollection", "Collection", "ObservableCollection"]


def mutable_public_collections(definitions: DataFrame) -> DataFrame:
    """Public collection properties with a public setter; ``has_public_setter`` marks it."""
    return definitions.where((F.col("kind") == "property") & (F.col("accessibility") == "public") & F.col("has_public_setter")).where(
        simple_type_name(F.col("return_type")).isin(MUTABLE_COLLECTIONS)
    )


def expected_namespace(path: Column, root: str, root_namespace: Column) -> Column:
    """The root namespace extended by the file's folders below ``root``."""
    prefix = re.escape(root.replace("\\", "/").rstrip("/"))
    inside = F.regexp_replace(F.translate(path, "\\", "/"), f"(?i)^{prefix}/", "")
    folder = F.regexp_replace(inside, r"/?[^/]*$", "")
    dotted = F.trim(F.translate(folder, "/", "."), F.lit("."))
    return F.when(dotted == "", root_namespace).otherwise(F.concat_ws(".", root_namespace, dotted))


def namespace_path_mismatches(files_ns: DataFrame, types: DataFrame) -> DataFrame:
    """Files whose namespace does not fit their folder, with severity and reason.

    ``files_ns``: (path, declared_ns, expected_ns, n_namespaces); ``types``: (path,
    type_name, is_partial). ``n_conflicts`` counts the other files declaring one of the
    file's types in the expected namespace, once per type.
    """
    files = files_ns.where(~is_generated(F.col("path")))
    several = F.col("n_namespaces") > 1
    single = files.where(~several)
    declared, expected = F.lower("declared_ns"), F.lower("expected_ns")
    mismatch = single.where(F.col("declared_ns").isNotNull() & (declared != expected))

    # Owners of each full name, collapsed to a count and one path: a common name stays one row.
    owners = (
        single.join(types, "path")
        .groupBy(F.concat_ws(".", F.coalesce("declared_ns", F.lit("")), "type_name").alias("full_name"))
        .agg(F.count_distinct("path").alias("n_owners"))
    )
    wanted = mismatch.join(types, "path").select(
        "path", F.concat_ws(".", "expected_ns", "type_name").alias("full_name")
    )
    conflicts = wanted.distinct().join(owners, "full_name").groupBy("path").agg(F.sum("n_owners").alias("n_conflicts"))

    reason = (
        F.when(several, "MultipleNamespacesInFile")
        .when(F.col("declared_ns").isNull(), "GlobalNamespace")
        .when(F.col("n_conflicts").isNotNull(), "DuplicateTypeAtMismatchedPath")
        .otherwise("NamespaceFolderMismatch")
    )
    wrong = several | (F.col("declared_ns").isNull() & (F.col("expected_ns") != "")) | (declared != expected)
    direct = (
        files.where(wrong)
        .join(conflicts, "path", "left")
        .select("path", "declared_ns", "expected_ns", reason.alias("reason"), F.coalesce("n_conflicts", F.lit(0).cast("long")).alias("n_conflicts"))
    )
    # A partial type spread over namespaces is reported once, at its first file, unless that
    # file is already reported.
    spread = (
        single.where(F.col("declared_ns").isNotNull())
        .join(types.where("is_partial"), "path")
        .groupBy(F.lower("type_name").alias("_type"))
        .agg(F.count_distinct(declared).alias("_n"), F.min("path").alias("path"), (F.count_distinct("path") - 1).alias("n_conflicts"))
        .where("_n > 1")
        .groupBy("path")
        .agg(F.max("n_conflicts").alias("n_conflicts"))
    )
    partial = (
        spread.join(direct, "path", "left_anti")
        .join(single.select("path", "declared_ns"), "path")
        .select("path", "declared_ns", F.lit("").alias("expected_ns"), F.lit("PartialClassAcrossNamespaces").alias("reason"), "n_conflicts")
    )
    severity = F.when(F.col("reason") == "DuplicateTypeAtMismatchedPath", "Error").otherwise("Warning")
    return direct.unionByName(partial).withColumn("severity", severity)


def namespace_conflicts(files_ns: DataFrame, types: DataFrame) -> DataFrame:
    """The files behind ``n_conflicts``: (path, type_name, conflicting_path).

    Pairs grow with the square of the files that share a full name, so they are not shuffled to
    be told apart: distinct sides make distinct pairs, but for a type of a path that is looked for
    under several full names.
    """
    single = files_ns.where("n_namespaces <= 1").where(~is_generated(F.col("path")))
    mismatch = single.where("lower(declared_ns) <> lower(expected_ns)")
    owners = single.join(types, "path").select(
        F.concat_ws(".", F.coalesce("declared_ns", F.lit("")), "type_name").alias("full_name"),
        F.col("path").alias("conflicting_path"),
    )
    wanted = mismatch.join(types, "path").select(
        "path", "type_name", F.concat_ws(".", "expected_ns", "type_name").alias("full_name")
    )
    names = F.count("*").over(Window.partitionBy("path", "type_name"))
    wanted, owners = cut_lineage(wanted.distinct().withColumn("_names", names)), cut_lineage(owners.distinct())
    pairs = wanted.join(owners, "full_name").where("path <> conflicting_path").select("path", "type_name", "conflicting_path", "_names")
    return pairs.where("_names = 1").drop("_names").unionByName(pairs.where("_names > 1").drop("_names").distinct())


def file_structure_smells(types: DataFrame) -> DataFrame:
    """Files declaring several types, and files not named after their first type.

    ``types``: (project, path, name, line).
    """
    per_file = (
        types.where(~F.endswith(F.lower("path"), F.lit(".g.cs")))
        .groupBy("project", "path")
        .agg(F.count("*").alias("n_types"), F.min(F.struct("line", "name")).alias("_first"))
        .withColumn("first_type", F.col("_first.name"))
    )
    host = F.col("project").rlike(r"(?i)\.apphost(?:\.|$)")
    smells = F.array_compact(
        F.array(
            F.when(F.col("n_types") > 1, "MULTI_TYPE"),
            F.when((file_stem(F.col("path")) != F.col("first_type")) & ~host, "NAME_MISMATCH"),
        )
    )
    return per_file.select("project", "path", "n_types", "first_type", F.explode(smells).alias("smell"))


def single_file_internals(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Internal types referenced from at most one file."""
    files = references.groupBy("symbol_id").agg(F.count_distinct("path").alias("n_files"))
    internal = definitions.where((F.col("kind") == "type") & (F.col("accessibility") == "internal"))
    return (
        internal.join(files, "symbol_id", "left")
        .na.fill(0, ["n_files"])
        .where("n_files <= 1")
    )


def mutable_public_properties(definitions: DataFrame) -> DataFrame:
    """Public instance properties with a public setter in public classes that do not merely
    carry data. ``has_public_setter`` marks the setter."""
    carrier = ends_with_any(F.col("container"), DATA_CARRIER_SUFFIXES)
    public = F.col("accessibility") == "public"
    classes = definitions.where((F.col("kind") == "type") & public).select(F.col("name").alias("container"))
    return (
        definitions.where((F.col("kind") == "property") & public & F.col("has_public_setter"))
        .where(~F.array_contains("modifiers", "static") & ~carrier)
        .join(classes.distinct(), "container", "left_semi")
    )


def unbounded_static_collections(
    definitions: DataFrame, references: DataFrame
) -> DataFrame:
    """Static collection fields that only grow: added to, never cleared or counted, in a
    class without a max or limit constant. ``references`` carries the called ``member``."""
    kind_name = simple_type_name(F.col("return_type"))
    fields = definitions.where(
        (F.col("kind") == "field") & F.array_contains("modifiers", "static") & kind_name.isin(GROWING_TYPES)
    )
    grown = references.where(F.col("member").isin(GROWING_CALLS)).select("symbol_id").distinct()
    bounded = references.where(F.col("member").isin("Clear", "Count")).select("symbol_id").distinct()
    limits = definitions.where(
        (F.col("kind") == "field") & F.array_contains("modifiers", "const") & F.lower("name").rlike("max|limit")
    ).select("container").distinct()
    return (
        fields.join(grown, "symbol_id", "left_semi")
        .join(bounded, "symbol_id", "left_anti")
        .join(limits, "container", "left_anti")
    )


