"""Operators on elements and pages. What SQL can say is columns, windows and joins; folds whose decisions depend on what they made before run per page or document."""
