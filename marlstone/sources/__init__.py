"""Tables, views and indexes: where they are kept and how they are read."""
