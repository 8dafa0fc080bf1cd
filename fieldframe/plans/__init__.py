"""The engine's queries over the driver's tables, each with SQL that says the same where SQL can."""
