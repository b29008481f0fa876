"""genospan: genotype analytics on Spark DataFrames."""

from .operators.ld import ld
from .operators.models import glm, pca, score
from .operators.shape import read_fileset, read_genotypes, read_vcf, shape
from .operators.stats import freq, hardy, missing
from .settings import set_setting, setting
from .sources.genotypes import Genotypes, load, load_many, vcf
from .sources.text import read_samples, read_variants

__all__ = [
    "Genotypes", "freq", "glm", "hardy", "ld", "load", "load_many", "missing", "pca", "read_fileset", "read_genotypes",
    "read_samples", "read_variants", "read_vcf", "score", "set_setting", "setting", "shape", "vcf",
]
