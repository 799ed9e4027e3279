"""Who may change owners and modes, as predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def may_chown(caller: Column, groups: Column, owner: Column, group: Column, new_owner: Column, new_group: Column) -> Column:
    """Root may; others may give a file of theirs to a group of theirs; changes to what is there already are none."""
    keeps_owner = new_owner.isNull() | (new_owner == owner)
    keeps_group = new_group.isNull() | (new_group == group)
    return (caller == 0) | (keeps_owner & (keeps_group | ((caller == owner) & F.array_contains(groups, new_group))))


def may_chmod(caller: Column, owner: Column) -> Column:
    return (caller == 0) | (caller == owner)
