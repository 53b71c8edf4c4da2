"""What the library raises. Whatever a schema alone decides is raised while the plan is built, the rest by an action."""


class TableError(Exception):
    """Base of the errors of tables and columns."""


class UnknownColumn(TableError):
    pass


class DuplicateColumn(TableError):
    pass


class TypeMismatch(TableError):
    pass


class DuplicateKeys(TableError):
    """The right side of a unique join has a key twice (a second null counts)."""


class SchemaProblems(TableError):
    """All problems of a table against a schema at once."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


class CSVTooShort(TableError):
    pass


class GraphError(Exception):
    """Base of the errors of graphs."""


class CycleDetected(GraphError):
    pass


class TooLarge(GraphError):
    """A sequential algorithm was asked for a graph above its stated bound."""
