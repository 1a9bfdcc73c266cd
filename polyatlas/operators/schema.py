"""Feature spaces, their registry, and checks of observation tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARSE, DENSE, INTERVAL = "sparse", "dense", "interval"


class Reconstructor(Protocol):
    """How a space's own matrix is made: a table (uid, global_index, layers...) or (uid, values) of the cells (uid, grp) at the features (global_index)."""

    def __call__(self, values: DataFrame, cells: DataFrame, layout: DataFrame, features: DataFrame, layers: Sequence[str]) -> DataFrame: ...


@dataclass(frozen=True)
class FeatureSpace:
    """How one kind of measurement is kept: its pointer kind, whether features are registered, and its value layers."""

    name: str
    kind: str
    registered: bool = True
    required: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    #: Used by ``to_matrix`` instead of the built-in plan of the kind.
    reconstruct: Reconstructor | None = field(default=None, compare=False)
    #: Kind of numbers of each layer: integer, float or any.
    dtypes: Mapping[str, str] = field(default_factory=dict, compare=False)
    #: Nesting of a dense layer's arrays.
    ndim: int = 1

    def check_layers(self, layers: Sequence[str]) -> tuple[str, ...]:
        """The layers to read: those asked for, else the required ones."""
        chosen = tuple(layers) or self.required
        if not chosen and self.kind != INTERVAL:
            raise ValueError(f"{self.name} has no required layers; name the layers to read")
        unknown = [x for x in chosen if self.allowed and x not in self.allowed]
        if unknown:
            raise ValueError(f"{self.name} has no layers {unknown}; allowed are {list(self.allowed)}")
        return chosen


_SPACES: dict[str, FeatureSpace] = {}


def register_space(space: FeatureSpace) -> FeatureSpace:
    if space.name in _SPACES:
        raise ValueError(f"feature space {space.name} is registered already")
    _SPACES[space.name] = space
    return space


def get_space(name: str) -> FeatureSpace:
    if name not in _SPACES:
        raise KeyError(f"no feature space {name}; known are {sorted(_SPACES)}")
    return _SPACES[name]


def registered_spaces() -> list[str]:
    return sorted(_SPACES)


for _space in (
    FeatureSpace("gene_expression", SPARSE, True, ("counts",), ("counts", "log_normalized", "tpm")),
    FeatureSpace("image_features", DENSE, True, ("raw",), ("raw", "log_normalized", "ctrl_standardized")),
    FeatureSpace("protein_abundance", DENSE, True, ("counts",), ("counts", "clr_normalized", "dsb_normalized")),
    FeatureSpace("chromatin_accessibility", INTERVAL),
    FeatureSpace("image_tiles", DENSE, False, ("data",), ("data",)),
):
    register_space(_space)

def _number_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "integer"
    return "float" if isinstance(data_type, (T.FractionalType, T.DecimalType)) else "other"


def group_errors(space: FeatureSpace, values: DataFrame) -> list[str]:
    """What is wrong with a table of values of one group: layers that are missing or not allowed, the wrong kind of numbers or nesting, arrays of unequal shape.

    Only shapes need the data; one row for each layer comes back.
    """
    fixed = {"uid", "grp", "local_index", "chrom", "start", "length", "cell"}
    layers = [c for c in values.columns if c not in fixed]
    errors = [f"{space.name}: no layer {x}" for x in space.required if x not in layers]
    errors += [f"{space.name}: layer {x} isn't allowed" for x in layers if space.allowed and x not in space.allowed]
    shaped = []
    for x in layers:
        kind, depth = values.schema[x].dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        want = space.ndim if space.kind == DENSE else 0
        if depth != want:
            errors.append(f"{space.name}: layer {x} has {depth} dimensions, not {want}")
        elif depth:
            shaped.append(x)
        expected = space.dtypes.get(x, "any")
        if _number_kind(kind) == "other" or expected not in ("any", _number_kind(kind)):
            errors.append(f"{space.name}: layer {x} holds {kind.simpleString()}, not {expected if expected != 'any' else 'numbers'}")
    if shaped:
        found = values.agg(*(F.count_distinct(F.size(x)).alias(f"n{i}") for i, x in enumerate(shaped))).first()
        errors += [f"{space.name}: layer {x} has arrays of {found[f'n{i}']} lengths" for i, x in enumerate(shaped) if found[f"n{i}"] > 1]
    return errors


@dataclass(frozen=True)
class PointerField:
    """A pointer column of a cell table and the space it points into."""

    name: str
    feature_space: str
    kind: str


def pointer_fields(schema: T.StructType) -> list[PointerField]:
    return [PointerField(n, n, get_space(n).kind) for n in check_cell_schema(schema)]


POINTER_FIELDS = frozenset({"feature_space", "grp"})


def pointer_columns(schema: T.StructType) -> list[str]:
    """Columns that point into a feature space, in declared order, known by the names of their sub-fields."""
    return [f.name for f in schema if isinstance(f.dataType, T.StructType) and set(f.dataType.fieldNames()) == POINTER_FIELDS]


def check_cell_schema(schema: T.StructType) -> list[str]:
    """Pointer columns of a cell table; raises unless there is one at least, each named like a registered space."""
    pointers = pointer_columns(schema)
    if "uid" not in schema.fieldNames() or "dataset_uid" not in schema.fieldNames():
        raise TypeError("a cell table needs uid and dataset_uid")
    if not pointers:
        raise TypeError("a cell table needs at least one pointer column")
    for name in pointers:
        if name not in _SPACES:
            raise TypeError(f"pointer column {name} isn't named like a feature space")
    return pointers


def validate_obs_columns(obs: DataFrame, schema: T.StructType, renames: Mapping[str, str] | None = None) -> list[str]:
    """What is missing: an error for each required (not nullable) column that ``obs`` lacks after renaming."""
    have = {(renames or {}).get(c, c) for c in obs.columns}
    return [f"missing required column {f.name}" for f in schema if not f.nullable and f.name not in have]


def align_obs(obs: DataFrame, schema: T.StructType, renames: Mapping[str, str] | None = None) -> DataFrame:
    """``obs`` in the form of ``schema``: renamed, optional columns null where absent, others dropped."""
    if errors := validate_obs_columns(obs, schema, renames):
        raise ValueError("; ".join(errors))
    obs = obs.withColumnsRenamed(dict(renames or {}))
    return obs.select(*((F.col(f.name) if f.name in obs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def auto_fields(obs: DataFrame, fields: Mapping[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """``obs`` with each field computed from the others by its function of the table; a field that is there already is replaced."""
    return obs.withColumns({name: make(obs) for name, make in fields.items()})


def search_string(types: Column, uids: Column, prefixes: Mapping[str, str]) -> Column:
    """Words ``prefix:uid`` of two parallel lists, for text search; a type without a prefix, or a null uid, has no word."""
    prefix = F.create_map(*(F.lit(x) for pair in prefixes.items() for x in pair))
    words = F.zip_with(types, uids, lambda t, u: F.concat(F.element_at(prefix, t), F.lit(":"), u.cast("string")))
    return F.array_join(F.array_compact(words), " ")


def integral_as_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of floats that hold whole numbers of 32 bits only become integers; one row comes back to tell."""
    if not columns:
        return df
    whole = df.agg(*(F.coalesce(F.bool_and((F.col(c) == F.floor(c)) & (F.abs(c) < 2**31)), F.lit(False)).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c).cast("int") for c in columns if whole[c]})


def row_errors(df: DataFrame, equal_lengths: Sequence[Sequence[str]] = (), domains: Mapping[str, Sequence[str]] | None = None, any_of: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(row columns, errors) of rows that break a rule: parallel lists of unequal length, values outside a domain, no identifier."""
    rules = []
    for names in equal_lengths:
        sizes = [F.coalesce(F.size(n), F.lit(-1)) for n in names]
        rules.append(F.when(F.greatest(*sizes) != F.least(*sizes), F.lit(f"unequal lengths: {', '.join(names)}")))
    for name, domain in (domains or {}).items():
        column = F.col(name)
        bad = F.exists(column, lambda x: ~x.isin(*domain)) if isinstance(df.schema[name].dataType, T.ArrayType) else ~column.isin(*domain)
        rules.append(F.when(bad, F.lit(f"outside the domain: {name}")))
    for names in any_of:
        rules.append(F.when(F.coalesce(*(F.col(n).cast("string") for n in names)).isNull(), F.lit(f"none of: {', '.join(names)}")))
    return df.withColumn("errors", F.array_compact(F.array(*rules))).where(F.size("errors") > 0)
