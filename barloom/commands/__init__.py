"""Programs: ``python -m barloom.commands.optimize``, ``.surge`` and ``.detect``."""
