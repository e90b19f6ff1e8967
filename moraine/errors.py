"""Errors of the table engine."""


class LakeError(Exception):
    """Something went wrong while a command ran."""


class ValidationError(LakeError):
    """The caller asked for something that isn't allowed; nothing was changed."""


class CommitConflict(ValidationError):
    """Another commit got in between and can't be reconciled with this one."""


def check(ok: object, message: str, *args: object) -> None:
    if not ok:
        raise ValidationError(message % args if args else message)
