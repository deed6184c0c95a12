"""skirmish.functions"""
