"""Schemas and configuration of the engine."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import types as T

#: Fixed value: distances and weights are stored as 16-bit integers, decoded by this factor (a product, not a division).
DECODE = 1.0 / 32767

POINTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
CENTROIDS = T.StructType([T.StructField("cid", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
CELLS = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])
ITERATION = T.StructType([
    T.StructField("t_cur", T.DoubleType()), T.StructField("stress", T.DoubleType()), T.StructField("stress_itr", T.IntegerType()), T.StructField("t_itr", T.IntegerType()),
    T.StructField("pre_stress", T.DoubleType()), T.StructField("t_min", T.DoubleType()), T.StructField("cg_count", T.IntegerType()),
])


@dataclass(frozen=True)
class ScalingConfig:
    """Parameters of multidimensional scaling; the names in a properties file are those of KEYS."""

    distance_file: str = ""
    weight_file: str = ""
    initial_points_file: str = ""
    points_file: str = ""
    points: int = -1
    dimension: int = 3
    threshold: float = 1e-6
    alpha: float = 0.95
    t_min_factor: float = 0.5
    cg_iterations: int = 20
    cg_threshold: float = 1.0
    big_endian_weights: bool = True
    max_temp_loops: int = 0
    max_stress_loops: int = 0
    exact_cg: bool = False
    generate_data: bool = False
    output_folder: str = ""
    out_file: str = ""
    iteration_file: str = ""

    @classmethod
    def read(cls, text: str, **overrides) -> ScalingConfig:
        """From the lines of a properties file; overrides win."""
        known = {f.name: f for f in fields(cls)}
        found = {}
        for line in text.splitlines():
            key, eq, value = line.partition("=")
            if eq and not line.lstrip().startswith(("#", "!")) and (name := KEYS.get(key.strip())):
                value = value.strip()
                kind = known[name].type
                found[name] = value.lower() == "true" if kind == "bool" else int(value) if kind == "int" else float(value) if kind == "float" else value
        return replace(cls(**found), **{k: v for k, v in overrides.items() if v is not None})


#: The keys of a configuration file.
KEYS = {
    "DistanceMatrixFile": "distance_file", "WeightMatrixFile": "weight_file", "InitialPointsFile": "initial_points_file", "PointsFile": "points_file",
    "NumberDataPoints": "points", "TargetDimension": "dimension", "Threshold": "threshold", "Alpha": "alpha", "TminFactor": "t_min_factor",
    "CGIterations": "cg_iterations", "CGErrorThreshold": "cg_threshold", "IsBigEndian": "big_endian_weights", "MaxTempLoops": "max_temp_loops",
    "MaxStressLoops": "max_stress_loops", "ExactCGIter": "exact_cg", "GenerateData": "generate_data", "OutputFolder": "output_folder",
    "OutFile": "out_file", "IterationFile": "iteration_file",
}
