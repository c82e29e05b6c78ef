"""ledgerlark: Spark jobs that audit expense statements against their evidence."""
