"""Errors of a caller's making; a rule that fails returns rows and raises nothing."""


class UserError(ValueError):
    """A wrong argument, found before any job runs."""


class InvalidPattern(UserError):
    pass


class InvalidOptions(UserError):
    pass


class InvalidLayer(UserError):
    pass


class InvalidDiagram(UserError):
    pass
