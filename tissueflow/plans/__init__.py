"""See the modules of this subpackage."""

from tissueflow.plans import registry, chosen, matrix, places, vectors, workloads  # noqa: F401, I001  the queries register themselves
