"""Keyword rules for the survey-sheet labels and the graph of its constraint types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of one table; they are held by every task.
MOST_RULES = 10_000

# fixed values: constraint component of a type text, first rule that matches
COMPONENT_RULES = (
    (r"type iii", "Physics Model as Input Feature"),
    (r"type ii process", "Governing Equation (architecture)"),
    (r"type ii", "Physical Topology (structural prior)"),
    (r"type i soft|^type i$", "Physics Loss Constraint"),
    (r"physics-emulator", "Physics-Emulator (training data)"),
    (r"physics-driven", "Real-Time Physical Observation"),
    (r"data-driven dynamic", "Statistical Correlation (dynamic)"),
    (r"data-driven static", "Statistical Correlation (static)"),
    (r"knowledge-static", "Domain Knowledge Graph"),
    (r"learned-dynamic|learned dynamic", "Data-Learned (dynamic)"),
    (r"learned-static|learned static|learned graph", "Data-Learned (static)"),
)
NO_COMPONENT = "No Constraint"

# fixed values: short label of a spatial architecture text, first rule that matches
SPATIAL_RULES = (
    (r"GraphSAGE", "GraphSAGE"),
    (r"GN block|Graph Network", "GN block"),
    (r"^(?!.*GCN).*MLP", "MLP"),
    (r"SageFormer", "SageFormer"),
    (r"Dense graph|Gaussian", "Dense / Gaussian RBF"),
    (r"GAT", "GAT"),
    (r"GNN", "GNN"),
    (r"GCN", "GCN"),
    (r"ChebNet", "ChebNet"),
)

# fixed values: constraint type of a sheet cell, longest text contained in it
TYPE_RULES = (
    ("type i", "Physics Loss Constraint"),
    ("type ii", "Physical Topology"),
    ("type ii + learned graph structure", "Topology + Data-Learned (hybrid)"),
    ("data-learned (static)", "Data-Learned (static)"),
    ("dynamic graph (physics-driven)", "Real-Time Physical Observation"),
)


# fixed values: groups of components
PATTERN_GROUPS = {
    "loss": ("Physics Loss Constraint",),
    "topology": ("Physical Topology (structural prior)", "Governing Equation (architecture)"),
    "learned": ("Data-Learned (dynamic)", "Data-Learned (static)"),
    "dynamic": ("Statistical Correlation (dynamic)", "Statistical Correlation (static)", "Real-Time Physical Observation"),
    "changing": ("Statistical Correlation (dynamic)", "Statistical Correlation (static)", "Real-Time Physical Observation", "Physics-Emulator (training data)", "Physics Model as Input Feature"),
}
# fixed values: groups that must occur, groups that must not, family; first rule that fits
PATTERN_RULES = (
    (("learned",), ("topology", "loss"), "Fully Data-Learned"),
    (("topology", "loss"), (), "Topology + Loss Penalty"),
    (("topology", "learned", "dynamic"), (), "Topology + Learned + Dynamic"),
    (("topology", "learned"), (), "Topology + Learned"),
    (("topology", "changing"), (), "Topology + Dynamic"),
    (("topology",), (), "Topology Only"),
    (("loss",), (), "Loss Penalty"),
)


def first_rule(text: Column, rules, default: Column | None = None) -> Column:
    """Label of the first pattern found in the text."""
    hits = [F.when(text.rlike(pattern), label) for pattern, label in rules]
    return F.coalesce(*hits, default) if default is not None else F.coalesce(*hits)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(position, pattern, label) from a sequence of (pattern, label), as such a table would be read from a file."""
    return spark.createDataFrame([(i, pattern, label) for i, (pattern, label) in enumerate(rules)], "position int, pattern string, label string")


def label_by_table(texts: DataFrame, rules: DataFrame, text: str, label: str = "label", default: str | None = None) -> DataFrame:
    """Add the label of the first rule, by position and then pattern, whose pattern is found in the text; else the default.

    `rules` has (position, pattern, label) and at most MOST_RULES rows: they are data, so a sheet of other rules needs no other code. Every row
    is matched where it is, so no text is moved; texts that are null get the default. Patterns are regular expressions in Java's syntax.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "pattern", "label")))
    checked = F.when(F.size("r") > MOST_RULES, F.raise_error(F.lit(f"more than {MOST_RULES} rules"))).otherwise(F.col("r"))
    held = rules.where(F.col("pattern").isNotNull()).agg(ordered.alias("r")).select(checked.alias("r")).scalar()
    first = F.get(F.filter("_rules", lambda rule: F.regexp_like(F.col(text), rule["pattern"])), F.lit(0))["label"]
    return texts.withColumn("_rules", held).withColumn(label, F.coalesce(F.when(F.col(text).isNotNull(), first), F.lit(default))).drop("_rules")


def spatial_label(text: Column) -> Column:
    return first_rule(text, SPATIAL_RULES, F.when(text.isNull(), "Other"))


def type_label(text: Column) -> Column:
    """Short constraint type; unmatched texts stay, null is Unknown."""
    flat = F.trim(F.regexp_replace(text, "\n", " "))
    hits = [F.when(F.lower(flat).contains(key), label) for key, label in sorted(TYPE_RULES, key=lambda rule: -len(rule[0]))]
    return F.coalesce(*hits, flat, F.lit("Unknown"))


def constraint_components(text: Column) -> Column:
    """'A + B' -> labels of the recognised parts; a part may repeat; none gives the default."""
    parts = F.transform(F.split(text, r"\+"), lambda p: first_rule(F.lower(F.trim(p)), COMPONENT_RULES))
    known = F.filter(parts, lambda p: p.isNotNull())
    empty = text.isNull() | F.lower(F.trim(text)).isin("nan", "none", "")
    return F.when(~empty & (F.size(known) > 0), known).otherwise(F.array(F.lit(NO_COMPONENT)))


def constraint_pattern(comps: Column) -> Column:
    """Family of a set of components by PATTERN_RULES; Other where none fits."""
    present = {group: F.arrays_overlap(comps, F.array(*[F.lit(n) for n in names])) for group, names in PATTERN_GROUPS.items()}
    out = F.lit(None).cast("string")
    for needed, excluded, family in PATTERN_RULES:
        fits = F.lit(True)
        for group in needed:
            fits &= present[group]
        for group in excluded:
            fits &= ~present[group]
        out = F.coalesce(out, F.when(fits, family))
    return F.coalesce(out, F.lit("Other"))


# fixed values: temporal architecture labels, first rule that matches
TEMPORAL_RULES = (
    (r"Muskingum|Cunge|δMC", "Muskingum-Cunge"),
    (r"^\s*AR\s*$|Autoregressive|AR rollout", "AR rollout"),
    (r"FEDformer|Frequency|TFT|Temporal Fusion|Transformer|SageFormer", "Transformer"),
    (r"TCN|Temporal Conv|T-GCN", "TCN / T-GCN"),
    (r"CNN", "CNN"),
    (r"GRU", "GRU"),
    (r"LSTM", "LSTM"),
    (r"RNN", "RNN"),
    (r"MLP", "MLP"),
    (r"Residual GCN", "Residual GCN"),
    (r"ELM|SVM", "ELM, SVM, MLP"),
    (r"Multi-step", "Multi-step function"),
)

# fixed values: node categories, matched in lower case
NODE_RULES = (
    (r"gauge|guage", "Gauge station"),
    (r"mesh|raster|cell", "Mesh / raster cell"),
    (r"reach", "River reach"),
    (r"junction", "River junction"),
    (r"drainage", "Drainage intersection"),
    (r"census", "Census tract"),
    (r"knowledge", "Knowledge graph node"),
    (r"token|series", "Dynamic token"),
)

# fixed values: edge categories, matched in lower case
EDGE_RULES = (
    (r"attention", "Attention-learned"),
    (r"knowledge graph", "Knowledge graph"),
    (r"correlation", "Statistical correlation"),
    (r"physical distance|flow direction|physical flow|physical interaction", "Physical flow direction"),
    (r"spatial relation|adjacency|spatial dependency|adjacent", "Spatial adjacency"),
    (r"topographic|physics-based", "Physics-routed"),
    (r"adaptive|functional|weighted", "Adaptive / hybrid"),
    (r"interdepend|inter-series", "Inter-series dependency"),
    (r"connectivity|connection", "Physical connectivity"),
    (r"river reacher", "River reach"),
    (r"distance", "Physical flow direction"),
)


def temporal_label(text: Column) -> Column:
    return first_rule(text, TEMPORAL_RULES, F.lit("Other"))


def node_label(text: Column) -> Column:
    return first_rule(F.lower(text), NODE_RULES, F.lit("Other"))


def edge_label(text: Column) -> Column:
    return first_rule(F.lower(text), EDGE_RULES, F.lit("Other"))


def graph_size(text: Column) -> Column:
    """First whole number once thousands commas are gone; 'Dynamic' and texts without digits give null."""
    digits = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+)", 1)
    return F.when(F.lower(F.trim(text)) != "dynamic", digits.try_cast("double"))
