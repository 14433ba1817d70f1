"""Reading and writing collections, exports and loads."""
