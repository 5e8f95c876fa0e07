"""Queries over the driver's tables; importing this registers them."""

from tidewater.plans import lifecycle, nodes, relational, scalar, searches, shown  # noqa: F401
