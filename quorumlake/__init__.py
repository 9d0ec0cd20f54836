"""quorumlake: analytics over collections of public-meeting minutes, written for Spark."""
