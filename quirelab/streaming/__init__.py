"""Empty: the operations of this library are batch jobs."""
