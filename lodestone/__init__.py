"""Lodestone: an analytics engine on Spark SQL and Catalyst."""

__all__ = ["Session"]


def __getattr__(name: str):
    if name == "Session":
        from .session import Session

        return Session
    raise AttributeError(name)
