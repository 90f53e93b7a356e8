"""Scoring functions that hold no state and therefore also take streaming DataFrames.

A fitted model can be applied to ``spark.readStream`` input with any of these; source, trigger
and sink are the caller's.
"""

from manyscale.operators.autoencoder import encode, reconstruct
from manyscale.operators.decomposition import affine_reconstruct, project
from manyscale.operators.tree import feature_vectors, project_points

__all__ = ["affine_reconstruct", "encode", "feature_vectors", "project", "project_points", "reconstruct"]
