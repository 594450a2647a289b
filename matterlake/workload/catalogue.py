"""All registered queries (importing a module registers its queries)."""

from matterlake.workload import (  # noqa: F401
    q_documents,
    q_matters,
    q_positions,
    q_rules,
    q_streams,
    registry,
)


def callables():
    return registry.callables()


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
