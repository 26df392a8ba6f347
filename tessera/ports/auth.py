"""Who is asking, and whether a saved query is theirs."""

from __future__ import annotations

from dataclasses import dataclass


class NotOwner(PermissionError):
    pass


@dataclass(frozen=True)
class Principal:
    user_id: str
    scheme: str


def authenticate(scheme: str, credential: str | None) -> Principal | None:
    """``local`` trusts its one operator; ``telegram`` takes a chat id; a blank credential is nobody."""
    if scheme == "local":
        return Principal("local", scheme)
    if scheme == "telegram":
        given = (credential or "").strip()
        return Principal(f"tg:{given}", scheme) if given else None
    raise NotImplementedError(f"scheme {scheme} is named only")


def authorized(owner: str, credential: str) -> bool:
    """A blank owner authorises nobody."""
    return bool(owner.strip()) and owner.strip() == credential.strip()


def require_owner(principal: Principal, user_id: str) -> None:
    if principal.user_id != user_id:
        raise NotOwner(f"{principal.user_id} doesn't own this query")
