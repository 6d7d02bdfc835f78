"""All registered queries; importing this module fills the registry."""

from gridhour.queries import checks, flows, grain, layouts, markets, streams, tables, whole  # noqa: F401
from gridhour.queries.base import REGISTRY

__all__ = ["REGISTRY"]
